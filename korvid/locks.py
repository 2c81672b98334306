"""Locks of sessions that share tables in one driver: strict two-phase, with intentions above the tables."""

from __future__ import annotations

import threading
import time

from korvid.errors import DeadlockError, LockTimeoutError

#: The modes that others may hold beside a mode.
BESIDE = {
    "IS": {"IS", "IX", "S", "SIX"},
    "IX": {"IS", "IX"},
    "S": {"IS", "S"},
    "SIX": {"IS"},
    "X": set(),
}
#: The resource above all tables.
DATABASE = ""


def upgraded(held: str | None, wanted: str) -> str:
    """The weakest mode that allows what both do: others may hold beside it what they may beside both."""
    if held is None:
        return wanted
    both = BESIDE[held] & BESIDE[wanted]
    return next(mode for mode, beside in BESIDE.items() if beside == both)


class LockTable:
    """Who holds what; timeout: seconds that a request waits at most (None: as long as it takes)."""

    def __init__(self, timeout: float | None = None):
        self.timeout = timeout
        self.latch = threading.RLock()
        self._changed = threading.Condition()
        self._held: dict[str, dict[object, str]] = {}
        self._waits: dict[object, set[object]] = {}

    def acquire(self, owner: object, resource: str, mode: str) -> str:
        """Waits for the mode, beside what the owner holds already, and returns what it holds then.

        A wait that would close a circle of waiting owners is a DeadlockError of this request.
        """
        end = None if self.timeout is None else time.monotonic() + self.timeout
        with self._changed:
            holders = self._held.setdefault(resource, {})
            goal = upgraded(holders.get(owner), mode)
            try:
                while against := {o for o, m in holders.items() if o is not owner and m not in BESIDE[goal]}:
                    self._waits[owner] = against
                    if self._waits_for_itself(owner):
                        raise DeadlockError(f"waiting for {mode} on {resource or 'the database'} would never end")
                    left = None if end is None else end - time.monotonic()
                    if left is not None and left <= 0:
                        raise LockTimeoutError(f"no {mode} on {resource or 'the database'} within {self.timeout} seconds")
                    self._changed.wait(left)
            finally:
                self._waits.pop(owner, None)
            holders[owner] = goal
            return goal

    def release(self, owner: object) -> None:
        """All that the owner holds."""
        with self._changed:
            for holders in self._held.values():
                holders.pop(owner, None)
            self._changed.notify_all()

    def held(self, owner: object) -> dict[str, str]:
        with self._changed:
            return {r: holders[owner] for r, holders in self._held.items() if owner in holders}

    def waiting(self) -> int:
        """How many requests wait."""
        with self._changed:
            return len(self._waits)

    def _waits_for_itself(self, owner: object) -> bool:
        seen, ahead = set(), set(self._waits[owner])
        while ahead:
            other = ahead.pop()
            if other is owner:
                return True
            if other not in seen:
                seen.add(other)
                ahead |= self._waits.get(other, set())
        return False
