"""Tokens of the dialect."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from korvid.errors import SQLLexError

#: The reserved words.
RESERVED = frozenset(
    """ACTION ALTER ANALYZE AND AS ASC AVG BEGIN BETWEEN BTREE BY CASCADE COMMIT COPY COUNT CREATE CROSS CSV DELETE DELIMITER
    DESC DISTANCIA DISTINCT DROP ENCODING END EUCLIDEAN EXISTS EXPLAIN FALSE FIRST FLOAT FOREIGN FORMAT FROM FULL GROUP HASH
    HAVERSINE HAVING HEADER HEAP IN INDEX INNER INSERT INT INTO IS JOIN KEY LAST LEFT LIKE LIMIT MAX MIN NO NOT NULL NULLS
    OFFSET ON OR ORDER OUTER POINT POLYGON PRIMARY REFERENCES RESTRICT RIGHT ROLLBACK RTREE SELECT SEQUENTIAL SET STR SUM
    TABLE TRANSACTION TRUE UNION UPDATE USING VALUES VARCHAR WHERE WITH WITHIN""".split()
)
_SCAN = re.compile(
    r"""(?P<space>\s+)|(?P<line>--[^\n]*)|(?P<block>/\*)
    |(?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<quoted>"(?:[^"]|"")*")|(?P<string>'(?:[^']|'')*')
    |(?P<symbol><>|!=|<=|>=|[(),;.*=<>+\-/%])""",
    re.X,
)
_BLOCK_MARK = re.compile(r"/\*|\*/")


@dataclass(frozen=True)
class Token:
    kind: str  # word, name, integer, float, string, symbol or end
    lexeme: str
    value: Any
    offset: int
    line: int
    column: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.value in words


def place(text: str, offset: int) -> tuple[int, int]:
    return text.count("\n", 0, offset) + 1, offset - (text.rfind("\n", 0, offset) + 1) + 1


def tokenize(text: str) -> list[Token]:
    """Reserved words are upper-cased words; other names are folded to lower case unless quoted."""
    out: list[Token] = []
    at = 0

    def fail(message: str, offset: int) -> SQLLexError:
        return SQLLexError(message, *place(text, offset), text)

    while at < len(text):
        m = _SCAN.match(text, at)
        if m is None:
            if text[at] in "'\"":
                raise fail("unterminated text" if text[at] == "'" else "unterminated quoted name", at)
            raise fail(f"unexpected character {text[at]!r}", at)
        kind, lexeme, start = m.lastgroup, m[0], at
        at = m.end()
        if kind in ("space", "line"):
            continue
        if kind == "block":
            depth = 1
            while depth:
                mark = _BLOCK_MARK.search(text, at)
                if mark is None:
                    raise fail("unterminated comment", start)
                depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
            continue
        line, column = place(text, start)
        if kind == "number":
            if at < len(text) and (text[at].isalnum() or text[at] in "_."):
                raise fail(f"malformed number {lexeme + text[at]!r}", start)
            whole = lexeme.isdigit()
            value: Any = int(lexeme) if whole else float(lexeme)
            if not whole and not math.isfinite(value):
                raise fail("number out of range", start)
            out.append(Token("integer" if whole else "float", lexeme, value, start, line, column))
        elif kind == "word":
            upper = lexeme.upper()
            out.append(Token("word", lexeme, upper, start, line, column) if upper in RESERVED else Token("name", lexeme, lexeme.lower(), start, line, column))
        elif kind == "quoted":
            name = lexeme[1:-1].replace('""', '"')
            if not name:
                raise fail("empty quoted name", start)
            out.append(Token("name", lexeme, name, start, line, column))
        elif kind == "string":
            out.append(Token("string", lexeme, lexeme[1:-1].replace("''", "'"), start, line, column))
        else:
            out.append(Token("symbol", lexeme, "!=" if lexeme == "<>" else lexeme, start, line, column))
    out.append(Token("end", "", None, len(text), *place(text, len(text))))
    return out
