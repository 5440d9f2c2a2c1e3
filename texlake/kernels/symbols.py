"""Unicode mathematics to commands: inside spans, and in tight clusters that become spans."""

from __future__ import annotations

import re

from ..tables import (
    GREEK_MATH_LETTERS,
    GREEK_UNIT_SYMBOLS,
    HOMOGLYPHS,
    JOINING_CHARS,
    JOINING_COMMANDS,
    RADICALS,
    SYMBOL_COMMANDS,
    TEXT_FAMILY,
    UNICODE_MATH,
    WRAPPABLE,
)
from .arguments import group_end
from .tokens import escaped, mask, ranges


def any_of(names) -> str:
    """A pattern for one of the names, longest first."""
    return "(?:" + "|".join(sorted(map(re.escape, names), key=lambda n: (-len(n), n))) + ")"


def chars(signs) -> str:
    return "[" + "".join(sorted(map(re.escape, signs))) + "]"


RAISED = "".join(c for c, v in UNICODE_MATH.items() if v.startswith("^{"))
LOWERED = "".join(c for c, v in UNICODE_MATH.items() if v.startswith("_{"))
SCRIPTS = RAISED + LOWERED
TRIGGER = chars(UNICODE_MATH)
_TRIGGER = re.compile(TRIGGER)
_WRAPPABLE = re.compile(chars(WRAPPABLE))
_SCRIPT_RUN = re.compile(f"({chars(RAISED)}+)|({chars(LOWERED)}+)")
_TEXT_OPEN = re.compile(r"\\" + any_of(TEXT_FAMILY) + r"\s*\{")
_PIECE = re.compile(f"(?P<text>{_TEXT_OPEN.pattern})|(?P<scripts>{chars(RAISED)}+|{chars(LOWERED)}+)|(?P<root>{chars(RADICALS)})|(?P<sign>{TRIGGER})")
_ROOT_NUMBER = re.compile(r"[-−]?\d+(?:\.\d+)?")
_AFTER_ROOT = frozenset("(^_⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ₀₁₂₃₄₅₆₇₈₉")
HOMOGLYPH_MAP = str.maketrans(HOMOGLYPHS)


def script_run(run: str) -> str:
    """One group for a run of raised or lowered characters."""
    mark = UNICODE_MATH[run[0]][0]
    return mark + "{" + "".join(UNICODE_MATH[c][2:-1] for c in run) + "}"


def radicand(text: str, at: int) -> tuple[str, int] | None:
    """(inside, end) of what a radical sign at ``at - 1`` takes, if it has one reading."""
    first = text[at : at + 1]
    if first in ("(", "{"):
        close, depth = {"(": ")", "{": "}"}[first], 0
        for m in re.finditer(r"[(){}$\n]", text[at:]):
            if m[0] in "$\n":
                return None
            depth += (m[0] == first) - (m[0] == close)
            if depth == 0 and m[0] == close:
                inside = text[at + 1 : at + m.start()]
                return (inside, at + m.end()) if inside.strip() else None
        return None
    number = _ROOT_NUMBER.match(text, at)
    end = number.end() if number else at + 1
    after = text[end : end + 1]
    if not (number or first.isalpha()) or after.isalnum() or after in _AFTER_ROOT and after:
        return None
    return text[at:end], end


def runs_on(command: str, follows: str) -> bool:
    """Whether a command's name would run into the letter that follows."""
    return command[:1] == "\\" and command[-1].isalpha() and follows.isalpha()


def to_commands(body: str) -> str:
    """Every Unicode sign of a math body as its command; text groups are copied."""
    if not _TRIGGER.search(body):
        return body
    out, at = [], 0
    while (m := _PIECE.search(body, at)) is not None:
        out.append(body[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            close = group_end(body, at - 1)
            at = close if close >= 0 else len(body)
            out.append(body[m.start() : at])
        elif kind == "scripts":
            out.append(script_run(m[0]))
        else:
            sign = m[0]
            if kind == "root":
                taken = radicand(body, at)
                if taken:
                    out.append(RADICALS[sign] + "{" + to_commands(taken[0]) + "}")
                    at = taken[1]
                    continue
                rest = body[at:].lstrip()
                if not rest or rest[0] in "}&^_" or rest.startswith("\\\\"):
                    out.append(sign)
                    continue
            command = UNICODE_MATH[sign]
            out.append(command + " " if runs_on(command, body[at : at + 1]) else command)
    return "".join([*out, body[at:]])


def math_to_commands(text: str) -> str:
    """``to_commands`` over the bodies of all math segments."""
    if not _TRIGGER.search(text):
        return text
    out, at = [], 0
    for start, end, _ in ranges(text):
        k = 2 if text.startswith(("$$", "\\"), start) else 1
        out += [text[at : start + k], to_commands(text[start + k : end - k]), text[end - k : end]]
        at = end
    return "".join([*out, text[at:]])


def convert_combining_vec(text: str) -> str:
    if "\u20d7" not in text:
        return text
    inside = mask(text)
    return re.sub("([A-Za-z])\u20d7", lambda m: f"\\vec{{{m[1]}}}" if inside[m.start()] else f"$\\vec{{{m[1]}}}$", text)


def normalize_homoglyphs(text: str) -> str:
    return text if text.isascii() else text.translate(HOMOGLYPH_MAP)


# --- clusters --------------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_ASCII_SCRIPT = re.compile(r"[_^](?:\{[^{}$\n]*\}|\\[A-Za-z]+|[A-Za-z0-9](?![A-Za-z]))")
_JOINING_COMMAND = re.compile(r"\\" + any_of(JOINING_COMMANDS) + "(?![A-Za-z])")
SYMBOL_COMMAND = re.compile(r"\\" + any_of(SYMBOL_COMMANDS) + "(?![A-Za-z])")
#: A Greek word is a run of these; a point or comma only between digits.
_GREEK_WORD = re.compile(f"(?:{chars(GREEK_MATH_LETTERS | set(SCRIPTS))}|[A-Za-z0-9]|(?<=[0-9])[.,](?=[0-9]))+")
_GREEK_UNIT = re.compile(f"[0-9]*(?:[.,][0-9]+)*(?:[kMGTmμµnp]?Ω(?:c?m)?|[μµ](?:{any_of(GREEK_UNIT_SYMBOLS)}|Ω)?){chars(SCRIPTS)}*")
_REFUSED = re.compile(f"[A-Za-z]{{3}}|{chars(GREEK_MATH_LETTERS)}{{3}}|[A-Z]{chars(LOWERED)}")
_SENTINEL = "\ue001"  # the last sign of an escaped dollar that canonicalize put aside


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


class Clusters:
    """Tight clusters of one text; ``inside`` marks its math."""

    def __init__(self, text: str, inside: list[bool] | None = None, commands: bool = False):
        self.text, self.commands = text, commands
        self.inside = inside or [False] * (len(text) + 1)
        self._words: dict[int, tuple[int, int] | None] | None = None

    def word(self, k: int) -> tuple[int, int] | None:
        """The accepted Greek word that holds position k."""
        if self._words is None:
            self._words = {}
            start = 0
            for end in range(1, len(self.text) + 1):  # runs of prose between spans
                if end == len(self.text) or self.inside[end] != self.inside[start]:
                    if not self.inside[start]:
                        self._read_words(start, end)
                    start = end
        return self._words.get(k)

    def _read_words(self, start: int, end: int) -> None:
        piece = self.text[start:end]
        for m in _GREEK_WORD.finditer(piece):
            found = self._accepted(start + m.start(), start + m.end())
            if found:
                self._words.update(dict.fromkeys(range(*found), found))

    def _accepted(self, s: int, e: int) -> tuple[int, int] | None:
        text, word = self.text, self.text[s:e]
        if not any(c in GREEK_MATH_LETTERS for c in word) or not any(c.isascii() and c.isalnum() for c in word):
            return None
        before, after = text[s - 1 : s] if s else "", text[e : e + 1]
        if before and not self.inside[s - 1] and (before.isalnum() or before in "\\^_{$" + _SENTINEL):
            return None
        if after and not self.inside[e] and after.isalnum():
            return None
        return None if _REFUSED.search(word) or _GREEK_UNIT.fullmatch(word) else (s, e)

    def joins(self, p: int) -> bool:
        return self.text[p : p + 1] in JOINING_CHARS or _JOINING_COMMAND.match(self.text, p) is not None

    def _operand(self, end: int, floor: int, lowered: bool) -> int:
        """Where the number or lone letter that ends at ``end`` starts; -1 if it may not join."""
        text = self.text
        if end <= floor or self.inside[end - 1]:
            return -1
        c = text[end - 1]
        if _digit(c):
            q = end - 1
            while q > floor and (_digit(text[q - 1]) or text[q - 1] in ".,") and not self.inside[q - 1]:
                q -= 1
            while text[q] in ".,":
                q += 1
            before = text[q - 1] if q else ""
            owned = before and (before in "\\^_$" + _SENTINEL or _letter(before) and _letter(text[q - 2 : q - 1] if q > 1 else ""))
            return -1 if owned else q
        if not _letter(c):
            return -1
        before = text[end - 2] if end > 1 else ""
        return -1 if before and (_letter(before) or before in "\\^_") or lowered and c.isupper() else end - 1

    def left(self, start: int, floor: int) -> int:
        if not self.joins(start):
            return start
        while start > floor and not self.inside[start - 1]:
            q = start
            while q > floor and self.text[q - 1] in SCRIPTS and not self.inside[q - 1]:
                q -= 1
            at = self._operand(q, floor, q < start and self.text[q] in LOWERED)
            if at < 0:
                break
            start = at
        return start

    def right(self, start: int) -> int:
        text, n, p, joined = self.text, len(self.text), start, False
        while p < n and not self.inside[p]:
            c, joining = text[p], False
            word = self.word(p) if c in GREEK_MATH_LETTERS or c.isascii() and c.isalnum() else None
            if word and word[0] >= start:
                p = word[1]
            elif c in RADICALS and c in WRAPPABLE:
                taken = radicand(text, p + 1)
                if not taken:
                    break
                p = taken[1]
            elif c in WRAPPABLE:
                joining = c in JOINING_CHARS
                p += 1
            elif c in SCRIPTS:
                while p < n and text[p] in SCRIPTS and not self.inside[p]:
                    p += 1
            elif c == "\\" and self.commands and (m := SYMBOL_COMMAND.match(text, p)):
                joining = self.joins(p)
                p = m.end()
            elif c in "_^" and p > start and (m := _ASCII_SCRIPT.match(text, p)):
                p = m.end()
            elif _digit(c):
                p = _NUMBER.match(text, p).end()
            elif _letter(c) and joined and not (p and _letter(text[p - 1])):
                after = text[p + 1 : p + 2]
                if _letter(after) or after == "(" or c.isupper() and after and after in LOWERED:
                    break
                p += 1
            else:
                break
            joined = joining
        return p

    def span(self, start: int, end: int) -> str:
        """The cluster as a span, with a space where a neighbour would break it."""
        text = self.text
        head = " " if start and text[start - 1] == "$" and not self.inside[start - 1] and text[start - 2 : start - 1] != "\\" else ""
        after = text[end : end + 1]
        tail = " " if after and not self.inside[end] and (after == "$" or after.isdigit()) else ""
        return f"{head}${convert_cluster(text[start:end])}${tail}"


def convert_cluster(cluster: str) -> str:
    out: list[str] = []
    at = 0
    while at < len(cluster):
        c = cluster[at]
        run = _SCRIPT_RUN.match(cluster, at)
        taken = radicand(cluster, at + 1) if c in RADICALS else None
        if run:
            piece, at = script_run(run[0]), run.end()
        elif taken:
            piece, at = RADICALS[c] + "{" + to_commands(taken[0]) + "}", taken[1]
        else:
            piece, at = UNICODE_MATH[c] if c in WRAPPABLE else c, at + 1
        if out and runs_on(out[-1], piece[0]):
            out.append(" ")
        out.append(piece)
    return "".join(out)


def _ends_command(text: str, end: int) -> bool:
    """Whether an unescaped command's name ends at ``end``."""
    m = re.search(r"\\[A-Za-z]+$", text[max(0, end - 64) : end])
    return m is not None and not escaped(text, max(0, end - 64) + m.start())


def attached_groups(text: str, inside: list[bool]) -> list[bool]:
    """Marks brace groups outside math that belong to a script or to a command's arguments."""
    out, closes = [False] * (len(text) + 1), set()
    for m in re.finditer(r"\{", text):
        k = m.start()
        if inside[k] or escaped(text, k):
            continue
        end = group_end(text, k)
        if end < 0 or "\n" in text[k:end] or any(inside[k:end]):
            continue
        before = text[k - 1 : k]
        attached = before in ("^", "_") or _ends_command(text, k) or k in closes
        if not attached and before == "]":
            o = text.rfind("[", 0, k - 1)
            attached = o > 0 and "]" not in text[o : k - 1] and _ends_command(text, o)
        if attached:
            out[k:end] = [True] * (end - k)
            closes.add(end)
    return out


def wrap_bare_unicode(text: str, skip_attached: bool = True) -> str:
    """Each bare symbol with its tight cluster as one span."""
    if not _WRAPPABLE.search(text):
        return text
    inside = mask(text)
    clusters = Clusters(text, inside)
    skipped = attached_groups(text, inside) if skip_attached and "{" in text else None
    out, last = [], 0
    for m in _WRAPPABLE.finditer(text):
        k = m.start()
        if k < last or inside[k] or skipped and skipped[k] or m[0] in RADICALS and not radicand(text, k + 1):
            continue
        word = clusters.word(k) if m[0] in GREEK_MATH_LETTERS else None
        if word and word[0] >= last:
            start = word[0]
            end = clusters.right(start)
        else:
            start, end = clusters.left(k, last), clusters.right(k)
        out += [text[last:start], clusters.span(start, end)]
        last = end
    return "".join([*out, text[last:]])
