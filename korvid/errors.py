"""Errors a user of the engine can meet."""

from __future__ import annotations


class SQLError(Exception):
    pass


class _Placed(SQLError):
    """An error at a place of the text: line, column and a caret below it."""

    def __init__(self, message: str, line: int, column: int, source: str = ""):
        self.message, self.line, self.column = message, line, column
        lines = source.split("\n")
        shown = f"\n{lines[line - 1]}\n{' ' * (column - 1)}^" if 0 < line <= len(lines) and source else ""
        super().__init__(f"line {line}, column {column}: {message}{shown}")


class SQLLexError(_Placed):
    pass


class SQLParseError(_Placed):
    pass


class SQLSemanticError(SQLError):
    pass


class SQLExecutionError(SQLError):
    pass


class SQLIntegrityError(SQLExecutionError):
    pass


class ConflictError(SQLExecutionError):
    """Another session changed a table that this transaction changed too."""


class DeadlockError(SQLExecutionError):
    """Sessions wait for each other's locks; the one that gets this has been rolled back."""


class LockTimeoutError(SQLExecutionError):
    """A lock wasn't granted in time; the statement failed, its transaction is still open."""
