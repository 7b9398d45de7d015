"""Tables that sources of programs hold as calls with literal arguments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

_STRING = r"""[A-Za-z]{0,2}(?:'''(?:[^'\\]|\\.|'(?!''))*'''|\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|"(?!"")(?:[^"\\\n]|\\.)*")"""
#: What a cutter must tell apart: comments, strings, brackets, commas, and everything else.
_PIECE = re.compile(rf"(?P<note>\#[^\n]*)|(?P<string>{_STRING})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<comma>,)|(?P<name>\w+(?:\s*\.\s*\w+)*)|.", re.S)
_QUOTES = re.compile(r"""^[A-Za-z]{0,2}('''|\"\"\"|'|")(.*)\1$""", re.S)


def _cut(source: str, name: str) -> list[list[str | None]]:
    """Arguments of all complete calls of `name`; an argument of strings alone is what they hold, escapes kept, others
    are as written. Calls inside other calls' arguments count too; comments and strings never do."""
    found: list[tuple[int, list]] = []
    open_calls: list[dict | None] = []
    called = None
    for m in _PIECE.finditer(source):
        kind, piece = m.lastgroup, m.group()
        if kind == "note" or (kind is None and piece.isspace()):
            continue
        if kind == "open":
            open_calls.append({"at": m.start(), "args": [], "now": []} if piece == "(" and called == name else None)
            inner = True
        elif kind == "close":
            call = open_calls.pop() if open_calls else None
            if call is not None and piece == ")":
                if call["now"]:
                    call["args"].append(call["now"])
                found.append((call["at"], [_value(source, a) for a in call["args"]]))
            inner = True
        else:
            inner = False
        for depth, call in enumerate(reversed(open_calls)):
            if call is None or (kind == "open" and depth == 0):
                continue
            if kind == "comma" and depth == 0:
                call["args"].append(call["now"])
                call["now"] = []
            else:
                call["now"].append((m.start(), m.end(), kind == "string" and not inner and depth == 0))
        called = re.sub(r"\s", "", piece) if kind == "name" else None
    return [args for _, args in sorted(found, key=lambda x: x[0])]


def _value(source: str, pieces: list[tuple[int, int, bool]]) -> str | None:
    if not pieces:
        return None
    if all(s for *_, s in pieces):
        return "".join(_QUOTES.match(source[a:b]).group(2) for a, b, _ in pieces)
    return source[pieces[0][0] : pieces[-1][1]]


def calls(source: Column, name: str) -> Column:
    """array<array<string>>: for each complete call of `name` (`Table.row`) in a source text, in order, its arguments.

    A cutter that knows comments, strings in one or three quotes of either kind, prefixes and escapes: brackets, commas
    and quotes inside literals are text. Neighbouring strings are joined. Escapes stay as written (`source_unescape`).
    An empty argument is null; null text has no calls. One source file is one row."""

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _cut(x or "", name))

    return F.pandas_udf(cut, "array<array<string>>")(source)


# How one source writes signs in its literals, and what they stand for.
WRITTEN = (("\\'", "'"), ('\\"', '"'), ("&#9;", " "), ("&#10;", "\n"), ("&quot;", "'"))


def source_unescape(text: Column, written=WRITTEN) -> Column:
    for a, b in written:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
