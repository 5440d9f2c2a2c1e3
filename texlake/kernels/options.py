"""normalize_option_text: one answer option as it is shown."""

from __future__ import annotations

import re

from .fixing import fix
from .tokens import segment

_WORDS = re.compile(r"\\text\s*\{([^{}\\$^_%&#]*)\}")
_ELEMENTS = re.compile("([A-Z][a-z]?[0-9]*){1,4}")
_CAPITALISED = re.compile(r"[A-Z][A-Za-z .,'\-]*")
_SYMBOL_BODY = re.compile(r"\\text\s*\{\s*([^{}]*?)\s*\}")
_SYMBOL = re.compile(r"\\?[%&#]|\\[A-Za-z]+|\^\\[A-Za-z]+")
_GROUP = re.compile(r"([\^_]\{[^{}]*\})")
_TEXT_WITH_SCRIPT = re.compile(r"\\text\s*\{((?:[^{}]|\{[^{}]*\})*?[\^_]\{[^{}]*\}(?:[^{}]|\{[^{}]*\})*)\}")


def _word(body: str) -> str | None:
    m = _WORDS.fullmatch(body.strip())
    if not m or not any(c.isalpha() for c in m[1]) or _ELEMENTS.fullmatch(m[1]):
        return None
    return m[1]


def _lift(m: re.Match) -> str:
    parts = [p if _GROUP.fullmatch(p) else f"\\text{{{p}}}" for p in _GROUP.split(m[1]) if _GROUP.fullmatch(p) or p.strip()]
    out, before = "".join(parts), ""
    while out != before:
        before, out = out, re.sub(r"\^\{([^{}]*)\}\^\{([^{}]*)\}", r"^{\1\2}", out)
    return out


def _bare(m: re.Match) -> str:
    if not _SYMBOL.fullmatch(m[1]):
        return m[0]
    before = m.string[m.start() - 1 : m.start()] if m.start() else " "
    return ("" if before.isspace() else " ") + re.sub(r"(?<!\\)([%&#])", r"\\\1", m[1])


def _prose(raw: str) -> str:
    raw = _WORDS.sub(lambda m: m[0] if m.string[m.end() : m.end() + 1] in ("_", "^") else m[1], raw)
    return raw.replace("\\{", "{").replace("\\}", "}")


def normalize_option_text(text: str | None, chemistry: bool = True) -> str | None:
    if not text:
        return text
    text = fix(text, chemistry)
    segments = segment(text.strip())
    if len(segments) == 1 and segments[0].math and not segments[0].display and segments[0].raw[0] == "$":
        body = segments[0].value.strip()
        word = _word(body)
        if word is None and _CAPITALISED.fullmatch(body) and re.search("[A-Z][a-z]{3,}", body):
            word = body
        if word is not None:
            return text[: len(text) - len(text.lstrip())] + word + text[len(text.rstrip()) :]
    out = []
    for s in segment(text):
        if not s.math:
            out.append(_prose(s.raw))
        elif s.raw[0] != "$":
            out.append(s.raw)
        else:
            edge = "$$" if s.display else "$"
            word = None if s.display else _word(s.value)
            out.append(edge + _SYMBOL_BODY.sub(_bare, _TEXT_WITH_SCRIPT.sub(_lift, s.value)) + edge if word is None else word)
    return "".join(out)
