"""Tokens with line numbers; comments and string contents are dropped."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from .languages import LANGUAGES


class Token(NamedTuple):
    text: str
    line: int
    column: int


NEWLINE = "\n"
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@lru_cache(maxsize=64)
def _pattern(language: str) -> re.Pattern:
    lang = LANGUAGES[language]
    lines, blocks = lang.comments
    parts = [f"(?P<c{i}>{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\Z))" for i, (a, b) in enumerate(blocks)]
    if lines:
        parts.append(f"(?P<line>(?:{'|'.join(map(re.escape, lines))})[^\\n]*)")
    for i, q in enumerate(lang.strings):
        # a quote after a name or a closing bracket is an operator (transpose), not a string
        before = r"(?<![\w)\]}'.])" if q == "'" and language in ("matlab", "rust", "scala", "haskell") else ""
        many = r"[\s\S]" if q == "`" else "."
        parts.append(rf"(?P<s{i}>{before}{q}(?:\\{many}|(?!{q}){many.replace('.', '[^\\n]')})*{q})")
    parts.append(r"(?P<t>\.(?:and|or|not)\.|[@$]?[A-Za-z_]\w*[?!]?(?=\W|$)|\d[\w.]*|&&|\|\||=>|->|<-|:-|\?\?|\?\.|\?:|:=|::|[=!<>]=|\.\.|\S)")
    parts.append(r"(?P<n>\n)")
    return re.compile("|".join(parts), re.IGNORECASE if lang.any_case else 0)


@lru_cache(maxsize=2)
def tokens(source: str, language: str) -> list[Token]:
    """The tokens of a source, newlines included; a string is the token \"\". The gate, the walker and the counts share them: do not change them."""
    lang = LANGUAGES[language]
    out, line, begin = [], 1, 0
    new, put, brace, any_case = tuple.__new__, out.append, lang.family == "brace", lang.any_case
    for m in _pattern(language).finditer(source):
        kind, text = m.lastgroup, m.group()
        column = m.start() - begin
        if kind == "t":  # nearly all of them, and none holds a line feed
            if brace and text[-1] in "?!" and len(text) > 1 and text[0].isalpha():
                name = text[:-1]
                put(new(Token, (name.lower() if any_case else name, line, column)))
                put(new(Token, (text[-1], line, column + len(name))))
            else:
                put(new(Token, (text.lower() if any_case else text, line, column)))
            continue
        if kind == "n":
            out.append(Token(NEWLINE, line, column))
        elif kind[0] == "s":
            out.append(Token('""', line, column))
        if "\n" in text:
            line += text.count("\n")
            begin = m.start() + text.rindex("\n") + 1
    return out


def partners(toks: list[Token]) -> dict[int, int]:
    """The closing place of every opening bracket; an unclosed one ends with the source."""
    stack, out = [], {}
    for i, t in enumerate(toks):
        if t.text in OPEN:
            stack.append(i)
        elif t.text in CLOSE:
            while stack:
                j = stack.pop()
                out[j] = i
                if toks[j].text == CLOSE[t.text]:
                    break
    for j in stack:
        out[j] = len(toks)
    return out


def balanced(toks: list[Token]) -> bool:
    """Whether all brackets pair up: the syntax gate of languages without a parser."""
    stack = []
    for t in toks:
        if t.text in OPEN:
            stack.append(t.text)
        elif t.text in CLOSE and (not stack or stack.pop() != CLOSE[t.text]):
            return False
    return not stack
