"""JSON text whose strings hold LaTeX, made safe for a standard parser."""

from __future__ import annotations

import json
import re

from ..tables import COLLISION_COMMANDS, PROSE_COMMANDS
from .tokens import segment

_STRING = re.compile(r'"((?:[^"\\]|\\.)*+)("|\Z)', re.S)
_ESCAPE = re.compile(r'\\(?:(u[0-9a-fA-F]{4}|["\\/])|([A-Za-z]+)|)', re.S)


def _inside(body: str) -> list[bool]:
    """Which characters of a raw string body lie in math."""
    out: list[bool] = []
    for s in segment(body):
        out += [s.math] * len(s.raw)
    return out


def _rewrite(body: str) -> str:
    if "\\" not in body:
        return body
    inside: list[bool] | None = None

    def escape(m: re.Match) -> str:
        nonlocal inside
        if m[1]:
            return m[0]
        run = m[2] or ""
        if run[:1] not in ("n", "t", "r") or not run:
            return "\\" + m[0]
        label = body[m.end() : m.end() + 1] == ":" and run.islower()
        if not label:
            inside = _inside(body) if inside is None else inside
            known = COLLISION_COMMANDS if inside[m.start()] else PROSE_COMMANDS
            if run not in known:
                return m[0]
        return "\\" + m[0]

    return _ESCAPE.sub(escape, body)


def escape_latex_for_json(text: str | None) -> str | None:
    """Backslashes that are no JSON escapes doubled, and those of escapes that spell a command."""
    if not text or "\\" not in text:
        return text
    return _STRING.sub(lambda m: f'"{_rewrite(m[1])}{m[2]}', text)


def loads_latex_aware(text: str, strict: bool = False):
    try:
        return json.loads(escape_latex_for_json(text), strict=strict)
    except ValueError:
        return json.loads(text, strict=strict)


def loads_model_json(text: str, lenient: bool = True):
    return json.loads(escape_latex_for_json(text), strict=False) if lenient else json.loads(text)
