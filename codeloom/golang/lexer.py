"""Tokens of a Go file. Positions are byte offsets: the source is read as Latin-1, so a character is a byte and every
byte above 0x7F counts as a letter."""

from __future__ import annotations

import re
from typing import NamedTuple

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS_LINE = frozenset({"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"})
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)
    |(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)
    |(?P<number>0[xX][0-9A-Fa-f_.]+(?:[pP][+-]?[0-9_]+)?i?|0[bBoO][0-9_]+i?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)
    |(?P<string>`[^`]*`|"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.[^'\n]*|[^'\\\n]+)')
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.S | re.X,
)


class Token(NamedTuple):
    kind: str  # name, keyword, number, string, char, op, end
    text: str
    start: int
    end: int


class SyntaxProblem(Exception):
    """The source does not follow the grammar."""


def tokens(source: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens, with a semicolon at the end of each line that ends a statement, and the spans of comments."""
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    at, n = 0, len(source)

    def close(place: int) -> None:
        if out and (out[-1].kind in ("name", "number", "string", "char") or out[-1].text in _ENDS_LINE):
            out.append(Token("op", ";", place, place))

    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            raise SyntaxProblem(f"offset {at}: unexpected {source[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "newline" or kind == "block" and "\n" in text:
            close(at)
        if kind in ("line", "block"):
            comments.append((at, m.end()))
        elif kind not in ("space", "newline"):
            out.append(Token("keyword" if text in KEYWORDS else kind, text, at, m.end()))
        at = m.end()
    close(n)
    out.append(Token("end", "", n, n))
    return out, comments
