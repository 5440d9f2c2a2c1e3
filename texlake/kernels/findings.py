"""audit: what is still broken in a text."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from ..tables import AUDIT_EXTRA_ALLOWED, BEHIND_JSON_ESCAPES, COLLISION_COMMANDS, KNOWN_COMMANDS, LOST_ESCAPE_RUNS, UNSUPPORTED_COMMANDS
from .arguments import fraction_positions, group_end, missing_argument_positions
from .mend import one_prior_dollars
from .tokens import mask, ranges

ALL_KINDS = (
    "control_char", "legacy_delimiter", "unbalanced_dollar", "command_missing_argument", "frac_missing_args", "script_missing_braces", "mojibake",
    "double_escaped_command", "unsupported_command", "bare_unicode_math", "unicode_chemistry", "bare_left_brace", "lost_escape",
)
ERROR_KINDS = ("control_char",)

#: Kinds that one pattern finds.
PATTERNS = {
    "legacy_delimiter": r"(?<!\\)\\[()\[\]]",
    "mojibake": "\ufffd|â€|[ÎÏ]|[âÂÃ][\x80-\xff]",
    "unicode_chemistry": "[A-Z][a-z]?[₀-₉]+",
    "bare_left_brace": r"\\left\{|\\right\}",
}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
_DROPPED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_SOFT = re.compile(r"([\t\n\r])([A-Za-z]+)")
_BARE = re.compile("[×÷±∓√∞∂∇≤≥≠≈≡∝→←↔⇌⇒⇐⇔∈∉⊂⊃⊆⊇∪∩∅∀∃∧∨αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ]")
_SCRIPT = re.compile(r"(?<!\\)[\^_](?:\d{2,}|[+\-][A-Za-z0-9]|[A-Za-z]{2,})")
_DOUBLED = re.compile(r"(?<!\\)(?:\\\\)+[A-Za-z]{2,}")
_JSON = re.compile(r'\{\s*"[^"\n]{1,80}"\s*:')
_ROWS = re.compile(r"\\begin\{|&")
_NAME = re.compile(r"(?<!\\)\\([A-Za-z]+)")
_NEVER = re.compile(r"\\(?:" + "|".join(UNSUPPORTED_COMMANDS) + r")(?![A-Za-z])")
_RUN = re.compile("[A-Za-z]+")
_TEXT_OPEN = re.compile(r"\\(?:text|textbf|textit|textrm|textsf|texttt|textnormal|textup|mathrm|mbox|hbox)\s*\{")


class Finding(NamedTuple):
    kind: str
    position: int
    snippet: str


def snippet(text: str, at: int, radius: int = 45, most: int = 120) -> str:
    visible = {9: "\\t", 10: "\\n", 13: "\\r"}
    window = "".join(visible.get(ord(c), f"<0x{ord(c):02x}>") if c < " " or c == "\x7f" else c for c in text[max(0, at - radius) : at + radius])
    return (("…" if at > radius else "") + window + ("…" if at + radius < len(text) else ""))[:most]


def paired_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the insides of closed spans, by pairing dollars in order; two in a row are one mark."""
    marks, out = one_prior_dollars(text), []
    k, opened = 0, -1
    while k < len(marks):
        width = 2 if k + 1 < len(marks) and marks[k + 1] == marks[k] + 1 else 1
        if opened < 0:
            opened = marks[k] + width
        else:
            out.append((opened, marks[k]))
            opened = -1
        k += width
    return out


def control_positions(text: str) -> list[int]:
    out = [m.start() for m in _DROPPED.finditer(text)]
    marks: list[int] | None = None
    for m in _SOFT.finditer(text):
        letter, run = {"\t": "t", "\n": "n", "\r": "r"}[m[1]], m[2]
        if m[1] == "\n" and len(run) < 3:
            continue
        if letter + run not in BEHIND_JSON_ESCAPES:
            if not any(c + run in COLLISION_COMMANDS for c in "ntr"):
                continue
            marks = one_prior_dollars(text) if marks is None else marks
            before = bisect_left(marks, m.start())
            if before % 2 == 0 or before == len(marks):
                continue
        out.append(m.start())
    return out


def _doubled(text: str) -> list[int]:
    found = [m.start() for m in _DOUBLED.finditer(text)]
    if not found or _JSON.search(text):
        return []
    rows = [(s, e) for s, e, _ in ranges(text) if _ROWS.search(text, s, e)]
    return [k for k in found if not any(s <= k < e for s, e in rows)]


def _unsupported(text: str) -> list[int]:
    out = {m.start() for m in _NEVER.finditer(text)}
    for start, end in paired_spans(text):
        out |= {m.start() for m in _NAME.finditer(text, start, end) if m[1] not in KNOWN_COMMANDS and m[1] not in AUDIT_EXTRA_ALLOWED}
    return sorted(out)


def _lost(text: str) -> list[int]:
    found = [m for m in _RUN.finditer(text) if m[0] in LOST_ESCAPE_RUNS]
    if not found:
        return []
    spans, controls = ranges(text), set(control_positions(text))
    groups = []
    for start, end, _ in spans:
        for m in _TEXT_OPEN.finditer(text, start, end):
            close = group_end(text, m.end() - 1, end)
            groups.append((m.start(), close if close >= 0 else end))
    inside = lambda k, parts: any(p[0] <= k < p[1] for p in parts)
    out = []
    for m in found:
        k = m.start()
        if text[k - 1 : k] == "\\" or k - 1 in controls:
            continue
        if not inside(k, groups) if inside(k, spans) else text[m.end() : m.end() + 1] == "{":
            out.append(k)
    return out


def positions(text: str) -> list[tuple[int, str]]:
    """(position, kind) of every finding, in order."""
    out = [(k, "control_char") for k in control_positions(text)]
    for kind, pattern in _PATTERNS.items():
        out += [(m.start(), kind) for m in pattern.finditer(text)]
    if "$" in text:
        marks = one_prior_dollars(text)
        if len(marks) % 2:
            out.append((marks[-1], "unbalanced_dollar"))
        for start, end in paired_spans(text):
            if end - start <= 400:
                out += [(m.start(), "script_missing_braces") for m in _SCRIPT.finditer(text, start, end)]
    if "\\" in text:
        out += [(k, "command_missing_argument") for k in missing_argument_positions(text)]
        out += [(k, "frac_missing_args") for k in fraction_positions(text)]
        out += [(k, "double_escaped_command") for k in _doubled(text)]
        out += [(k, "unsupported_command") for k in _unsupported(text)]
    if not text.isascii() and _BARE.search(text):
        inside = mask(text)
        out += [(m.start(), "bare_unicode_math") for m in _BARE.finditer(text) if not inside[m.start()]]
    out += [(k, "lost_escape") for k in _lost(text)]
    return sorted(out)


def audit(text: str | None) -> list[Finding]:
    return [Finding(kind, k, snippet(text, k)) for k, kind in positions(text)] if text else []


def audit_kinds(text: str | None) -> list[str]:
    return [kind for _, kind in positions(text)] if text else []


def is_error(kinds) -> bool:
    return any(k in ERROR_KINDS for k in kinds)
