"""Tokens of the dialect."""

from __future__ import annotations

import dataclasses
import re

from ..errors import QueryError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`[^`]*`)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=>|<<|>>|<=|>=|<>|!=|==|\|\||[-+*/%^~&|!=<>(),.;:])""",
    re.VERBOSE | re.DOTALL,
)


@dataclasses.dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, word, op, end
    text: str
    at: int

    def __repr__(self) -> str:
        return self.text or "end of input"


def unescape(body: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body, flags=re.DOTALL)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise QueryError(f"unexpected character '{sql[at]}' at {at}")
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            out.append(Token("string", unescape(text[1:-1]), at))
        elif kind == "quoted":
            out.append(Token("name", text[1:-1], at))
        elif kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", at)]
