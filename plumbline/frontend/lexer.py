"""Tokens of Java source."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, word, number, string, char, op
    text: str
    line: int
    col: int
    end_line: int


# The language's reserved words, and its operators with the longest first.
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
OPERATORS = ">>>= <<= >>= >>> ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << >> ( ) { } [ ] ; , . @ = > < ! ~ ? : + - * / & | ^ %".split()

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
  | (?P<string>\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|"(?:[^"\\\n]|\\.)*"?)
  | (?P<char>'(?:[^'\\\n]|\\.)+'?)
  | (?P<number>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)[lLfFdD]?)
  | (?P<id>[^\W\d][\w$]*|\$[\w$]*)
  | (?P<op>"""
    + "|".join(re.escape(o) for o in OPERATORS)
    + r""")
  | (?P<other>.)""",
    re.X | re.S,
)


def tokenize(source: str) -> list[Token]:
    """All tokens but white space and comments; what isn't Java is passed over."""
    out, line, begin = [], 1, 0
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind not in ("space", "other"):
            if kind == "id" and text in RESERVED:
                kind = "word"
            out.append(Token(kind, text, line, m.start() - begin, line + text.count("\n")))
        breaks = text.count("\n")
        if breaks:
            line += breaks
            begin = m.start() + text.rfind("\n") + 1
    return out


def clone_tokens(source: str) -> list[tuple[str, int]]:
    """``(key, line)`` for clone detection: names and literals by spelling, everything else as it is; comments don't count."""
    found, tokens, i = [], tokenize(source), 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "id":
            if i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].text == "class":
                found.append((f"literal:{t.text}.class", t.line))  # a class literal is one token
                i += 3
                continue
            found.append((f"id:{t.text}", t.line))
        elif t.kind in ("number", "string", "char") or t.text == "null":
            found.append((f"literal:{t.text}", t.line))
        else:
            found.append((t.text, t.line))
        i += 1
    return found
