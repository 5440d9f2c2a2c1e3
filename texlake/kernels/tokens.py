"""The tokenizer: text and math segments, and what follows from them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

_COMMAND = re.compile(r"\\[A-Za-z]")
NOT_PLAIN = r"[\\$*~`|\[\]<>#\r⸻【]|\n\n|--|(?:^|\n)[ \t]+\S|(?:^|\n)(?:[-*+] |\d+[.)] )|\([xX ]\) "
_NOT_PLAIN = re.compile(NOT_PLAIN)


class Segment(NamedTuple):
    kind: str
    display: bool
    value: str
    raw: str

    @property
    def math(self) -> bool:
        return self.kind == "math"


def backslashes_before(text: str, i: int) -> int:
    k = i
    while k and text[k - 1] == "\\":
        k -= 1
    return i - k


def escaped(text: str, i: int) -> bool:
    """Whether an odd run of backslashes stands before ``i``."""
    return backslashes_before(text, i) % 2 == 1


#: What the tokenizer reads: a backslash hides the character behind it, braces nest, dollars may open or close.
SIGN = re.compile(r"\\.?|[{}$]", re.S)
_CLOSERS = {"\\[": "\\]", "\\(": "\\)", "$": "$", "$$": "$$"}


class _Open:
    """Closers of one kind that stand further on, seen from right to left: of those no shallower than a nearer one,
    none is ever the next, so what stays is sorted by depth and the next at a depth or above is found by halving."""

    def __init__(self):
        self.depths: list[int] = []
        self.tokens: list[int] = []

    def add(self, token: int, depth: int) -> None:
        while self.depths and self.depths[-1] >= depth:
            self.depths.pop()
            self.tokens.pop()
        self.depths.append(depth)
        self.tokens.append(token)

    def next(self, depth: int) -> int:
        k = bisect_right(self.depths, depth)
        return self.tokens[k - 1] if k else -1


def signs_of(text: str) -> tuple[list[int], list[str]]:
    found = [(m.start(), m[0]) for m in SIGN.finditer(text)]
    return [i for i, _ in found], [sign for _, sign in found]


def partners(text: str, at: list[int], signs: list[str]) -> list[int]:
    """For each sign that may open a span, the sign that closes it outside the braces in between; -1 if none does."""
    depths, depth = [], 0
    for sign in signs:
        depths.append(depth)
        depth += (sign == "{") - (sign == "}")
    ahead = {kind: _Open() for kind in _CLOSERS.values()}
    double = [sign == "$" and text.startswith("$$", i) for i, sign in zip(at, signs, strict=True)]
    out = [-1] * len(at)
    for k in range(len(at) - 1, -1, -1):
        if k + 2 < len(at) and double[k + 2]:  # a double dollar closes from its own second sign on
            ahead["$$"].add(k + 2, depths[k + 2])
        sign = "$$" if double[k] else signs[k]
        if sign in _CLOSERS:
            out[k] = ahead[_CLOSERS[sign]].next(depths[k])
        if signs[k] in ahead:
            ahead[signs[k]].add(k, depths[k])
    return out


class Span(NamedTuple):
    start: int
    first: int
    last: int
    end: int
    display: bool


@lru_cache(maxsize=16)
def spans(text: str) -> tuple[Span, ...]:
    """The math spans, in one pass over the signs; the steps of a pass share it while they leave the text as it is."""
    if "$" not in text and "\\[" not in text and "\\(" not in text:
        return ()
    at, signs = signs_of(text)
    closing, out, k = partners(text, at, signs), [], 0
    while k < len(at):
        span = _span(text, at[k], signs[k], at[closing[k]]) if closing[k] >= 0 else None
        if span is None:
            k += 1
        else:
            out.append(span)
            k = closing[k] + (2 if span.display and signs[k] == "$" else 1)
    return tuple(out)


def _span(text: str, i: int, sign: str, close: int) -> Span | None:
    if sign != "$":
        return Span(i, i + 2, close, close + 2, sign == "\\[")
    if text.startswith("$$", i):
        return Span(i, i + 2, close, close + 2, True) if close > i + 2 else None
    empty = close <= i + 1 or text[i + 1].isspace() or text[close - 1].isspace()
    if empty or text[close + 1 : close + 2].isdigit() or text.find("\n", i, close) >= 0:
        return None
    return Span(i, i + 1, close, close + 1, False)


def segment(text: str | None) -> list[Segment]:
    return list(_segments(text)) if text else []


@lru_cache(maxsize=16)
def _segments(text: str) -> tuple[Segment, ...]:
    out, begun = [], 0
    for start, first, last, end, display in spans(text):
        if start > begun:
            out.append(_prose(text[begun:start]))
        value = text[first:last]
        out.append(Segment("math", display, value.strip() if text.startswith("\\(", start) else value, text[start:end]))
        begun = end
    if begun < len(text):
        out.append(_prose(text[begun:]))
    return tuple(out)


def _prose(raw: str) -> Segment:
    return Segment("text", False, _unescape_dollars(raw), raw)


def _unescape_dollars(raw: str) -> str:
    if "\\$" not in raw:
        return raw
    return re.sub(r"(?<!\\)((?:\\\\)*)\\\$", r"\1$", raw)


def ranges(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, display) of the math segments."""
    return [(s.start, s.end, s.display) for s in spans(text)] if text else []


def outside(text: str, pattern: re.Pattern):
    """Matches of ``pattern`` over the whole text that begin in no math segment."""
    left = list(reversed(spans(text)))
    for m in pattern.finditer(text):
        while left and left[-1].end <= m.start():
            left.pop()
        if not left or m.start() < left[-1].start:
            yield m


def mask(text: str) -> list[bool]:
    """For each character whether it lies in a math segment; one more entry, false, for the end."""
    out = [False] * (len(text) + 1)
    for start, end, _ in ranges(text):
        out[start:end] = [True] * (end - start)
    return out


def between(text: str, opener: str, closer: str, f: Callable[[str], str]) -> str:
    """``f`` over what each opener and the next closer enclose, instead of it and them; a backslash right before one hides it."""

    def bare(sign: str, at: int) -> int:
        while (at := text.find(sign, at)) > 0 and text[at - 1] == "\\":
            at += 1
        return at

    out, begun, at = [], 0, bare(opener, 0)
    while at >= 0 and (close := bare(closer, at + len(opener))) >= 0:
        out += [text[begun:at], f(text[at + len(opener) : close])]
        begun = close + len(closer)
        at = bare(opener, begun)
    return "".join([*out, text[begun:]])


def map_text(text: str, f: Callable[[str], str]) -> str:
    return "".join(s.raw if s.math else f(s.raw) for s in segment(text))


def map_dollar_math(text: str, f: Callable[[str], str]) -> str:
    """``f`` over the bodies of ``$…$`` and ``$$…$$`` segments."""
    out = []
    for s in segment(text):
        if s.math and s.raw[0] == "$":
            edge = "$$" if s.display else "$"
            out.append(edge + f(s.value) + edge)
        else:
            out.append(s.raw)
    return "".join(out)


def contains_math(text: str | None) -> bool:
    return bool(text) and (_COMMAND.search(text) is not None or any(s.math for s in segment(text)))


def is_plain_prose(text: str | None) -> bool:
    return text is not None and _NOT_PLAIN.search(text) is None
