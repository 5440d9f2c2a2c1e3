"""A cursor over math source: arguments, groups and table rows."""

from __future__ import annotations

import re

COMMAND = re.compile(r"\\+([A-Za-z]+)")
ENVIRONMENT = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}")
_CELL = re.compile(r"\\(?:begin|end)\s*\{[^{}]*\}|\\\\|\\[\s\S]?|[{}&]")


class Reader:
    """Source and a position. Braces count without escapes, as callers have put escaped ones aside."""

    def __init__(self, source: str, at: int = 0):
        self.source, self.at = source, at

    def skip_blanks(self) -> int:
        at = self.at
        while self.source[at : at + 1] in (" ", "\t"):
            at += 1
        return at

    def group(self) -> str:
        """The inside of the group that opens here; an unclosed one runs to the end."""
        start, depth = self.at + 1, 0
        for m in re.compile("[{}]").finditer(self.source, self.at):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                self.at = m.end()
                return self.source[start : m.start()]
        self.at = len(self.source)
        return self.source[start:]

    def argument(self) -> str | None:
        """A group, a control word or one character behind blanks; None (and no move) at the end or before a ``}``."""
        at = self.skip_blanks()
        first = self.source[at : at + 1]
        if first in ("", "}"):
            return None
        self.at = at
        if first == "{":
            return self.group()
        word = COMMAND.match(self.source, at)
        self.at = word.end() if word else at + 1
        return self.source[at : self.at]

    def option(self) -> str | None:
        """The inside of a ``[…]`` behind blanks, if one opens and closes."""
        at = self.skip_blanks()
        close = self.source.find("]", at) if self.source[at : at + 1] == "[" else -1
        if close < 0:
            return None
        self.at = close + 1
        return self.source[at + 1 : close]


def table(body: str) -> list[list[str]]:
    """Rows of cells, split at the top level only."""
    rows, cell, depth, nested, last = [[]], "", 0, 0, 0
    for m in _CELL.finditer(body):
        top = depth == 0 and nested == 0
        cell += body[last : m.start()]
        last = m.end()
        sign = m[0]
        if sign == "\\\\" and top or sign == "&" and top:
            rows[-1].append(cell)
            cell = ""
            if sign != "&":
                rows.append([])
            continue
        if sign.startswith(("\\begin", "\\end")):
            nested += 1 if sign[1] == "b" else -1
        elif sign in "{}":
            depth += 1 if sign == "{" else -1
        cell += sign
    rows[-1].append(cell + body[last:])
    return rows
