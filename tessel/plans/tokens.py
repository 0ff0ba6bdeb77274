"""Tokens of the SQL dialect, found by one regular expression."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import SqlSyntaxError


class Token(NamedTuple):
    kind: str  # word, name (quoted), int, float, text, op, end
    value: str
    at: int


SHAPES = re.compile(
    r"""
    (?P<skip>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<float>\d+\.\d*)
  | (?P<int>\d+)
  | (?P<word>[^\W\d]\w*)
  | (?P<backtick>`(?:[^`]|``)*`)
  | (?P<double>"(?:[^"]|"")*")
  | (?P<text>'(?:[^'\\]|''|\\.)*')
  | (?P<op>->>|->|<>|!=|<=|>=|[=<>+\-*/(),.;?])
    """,
    re.VERBOSE | re.DOTALL,
)

# Escapes within string literals; any other backslash stands for itself.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "'": "'"}


def unescape(body: str) -> str:
    return re.sub(r"''|\\(.)", lambda m: "'" if m[0] == "''" else ESCAPES.get(m[1], m[0]), body, flags=re.DOTALL)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = SHAPES.match(sql, at)
        if not m:
            raise SqlSyntaxError(f"Unexpected character at {at}: {sql[at : at + 20]!r}")
        kind, value = m.lastgroup, m[0]
        if kind == "backtick":
            kind, value = "name", value[1:-1].replace("``", "`")
        elif kind == "double":
            kind, value = "name", value[1:-1].replace('""', '"')
        elif kind == "text":
            value = unescape(value[1:-1])
        if kind != "skip":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
