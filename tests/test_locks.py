"""Lock modes, waiting, circles and time limits, and sessions that share tables through them."""

import threading
import time

import pytest

from korvid.engine import Engine
from korvid.errors import DeadlockError, LockTimeoutError, SQLIntegrityError
from korvid.locks import BESIDE, LockTable, upgraded


@pytest.mark.parametrize("held", BESIDE)
@pytest.mark.parametrize("wanted", BESIDE)
def test_modes(held, wanted):
    locks = LockTable(timeout=0)
    locks.acquire("a", "t", held)
    if wanted in BESIDE[held]:
        assert locks.acquire("b", "t", wanted) == wanted
    else:
        with pytest.raises(LockTimeoutError):
            locks.acquire("b", "t", wanted)
        locks.release("a")
        assert locks.acquire("b", "t", wanted) == wanted
    assert (held in BESIDE[wanted]) == (wanted in BESIDE[held])


def test_upgrades():
    assert [upgraded(*x) for x in (("S", "IX"), ("IX", "S"), ("IS", "S"), ("SIX", "IX"), ("X", "IS"), ("S", "X"), (None, "IS"))] == ["SIX", "SIX", "S", "SIX", "X", "X", "IS"]


def test_a_waiter_goes_on_when_the_lock_is_free():
    locks, got = LockTable(), []
    locks.acquire("a", "t", "X")
    waiter = threading.Thread(target=lambda: got.append(locks.acquire("b", "t", "S")))
    waiter.start()
    waiter.join(0.2)
    assert not got
    locks.release("a")
    waiter.join(10)
    assert got == ["S"] and locks.held("b") == {"t": "S"}


def test_who_closes_a_circle_gets_the_error():
    locks, ended = LockTable(timeout=20), []
    for owner, name in zip("abc", "xyz"):
        locks.acquire(owner, name, "X")

    def wait(owner, name):
        locks.acquire(owner, name, "S")
        ended.append(owner)
        locks.release(owner)

    waiters = [threading.Thread(target=wait, args=x) for x in (("a", "y"), ("b", "z"))]
    for w in waiters:
        w.start()
    while locks.waiting() < 2:
        time.sleep(0.01)
    with pytest.raises(DeadlockError):
        locks.acquire("c", "x", "X")
    locks.release("c")
    for w in waiters:
        w.join(10)
    assert sorted(ended) == ["a", "b"]


@pytest.fixture()
def sessions(spark, tmp_path):
    locks = LockTable(timeout=0.5)
    one = Engine(spark, str(tmp_path / "tables"), locks)
    one.execute("CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a ON DELETE CASCADE); INSERT INTO a VALUES (1)")
    return one, Engine(spark, str(tmp_path / "tables"), locks)


def test_sessions_change_different_tables(sessions):
    one, two = sessions
    two.execute("CREATE TABLE c (id INT)")
    one.execute("BEGIN; INSERT INTO a VALUES (2)")
    two.execute("INSERT INTO c VALUES (7)")
    one.execute("COMMIT")
    assert two.execute("SELECT id FROM a ORDER BY id").rows() == [(1,), (2,)]
    assert one.execute("SELECT id FROM c").rows() == [(7,)]


def test_no_dirty_read_and_no_lost_update(sessions):
    one, two = sessions
    one.execute("BEGIN; INSERT INTO a VALUES (2)")
    for s in ("SELECT id FROM a", "INSERT INTO b VALUES (5, 2)", "CREATE TABLE d (id INT)"):
        with pytest.raises(LockTimeoutError):
            two.execute(s)
    one.execute("ROLLBACK")
    with pytest.raises(SQLIntegrityError):
        two.execute("INSERT INTO b VALUES (5, 2)")
    two.execute("INSERT INTO a VALUES (2); INSERT INTO b VALUES (5, 2)")
    with pytest.raises(SQLIntegrityError):
        one.execute("INSERT INTO a VALUES (2)")
    one.execute("DELETE FROM a WHERE id = 2")
    assert two.execute("SELECT id FROM b").rows() == []


def test_definitions_inside_a_transaction(sessions):
    one, two = sessions
    one.execute("BEGIN; INSERT INTO a VALUES (3); CREATE TABLE e (id INT); INSERT INTO e VALUES (1)")
    assert one.execute("SELECT id FROM e").rows() == [(1,)]
    with pytest.raises(LockTimeoutError):
        two.execute("SELECT id FROM b")
    one.execute("COMMIT")
    assert two.execute("SELECT id FROM e").rows() == [(1,)] and len(two.execute("SELECT id FROM a").rows()) == 2
    one.execute("BEGIN; CREATE TABLE f (id INT); ROLLBACK")
    assert not two.catalog.has("f")


def test_upgrade_of_two_readers_rolls_one_back(spark, tmp_path):
    locks = LockTable(timeout=60)
    one, two = (Engine(spark, str(tmp_path / "tables"), locks) for _ in range(2))
    one.execute("CREATE TABLE a (id INT PRIMARY KEY)")
    for s in (one, two):
        s.execute("BEGIN; SELECT id FROM a")
    waiter = threading.Thread(target=lambda: one.execute("INSERT INTO a VALUES (1); COMMIT"))
    waiter.start()
    while not locks.waiting():
        time.sleep(0.01)
    with pytest.raises(DeadlockError):
        two.execute("INSERT INTO a VALUES (2)")
    waiter.join(60)
    assert not two.in_transaction and two.execute("SELECT id FROM a").rows() == [(1,)]
