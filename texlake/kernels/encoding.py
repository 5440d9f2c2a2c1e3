"""Entities and mojibake."""

from __future__ import annotations

import html
import re

from ..tables import MOJIBAKE, NAMED_ENTITIES

_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_MISREAD = re.compile("|".join(re.escape(k) for k in sorted(MOJIBAKE, key=lambda k: (-len(k), k))))
_BY_LENGTH = sorted(MOJIBAKE, key=len, reverse=True)
_FIRST = re.compile("[" + re.escape("".join(sorted({k[0] for k in MOJIBAKE}))) + "]")
#: Present symbols hide behind private signs while the context rules run, so that only a pair a rule made collapses.
_HIDDEN = {"π": "\ue020", "ω": "\ue021", "√": "\ue022"}
_G = "[\u0080-\u009f -ÿ]"
# Readings of a damaged root, pi or omega by what stands around it.
_CONTEXT = [
    (re.compile(f"â{_G}{{0,3}}(\\d+)"), r"√\1"),
    (re.compile(f"â{_G}{{0,3}}\\("), "√("),
    (re.compile(f"([A-Za-z])â{_G}{{0,3}}(\\d)"), r"\1√\2"),
    (re.compile(f"/â{_G}{{0,3}}(\\d)"), r"/√\1"),
    (re.compile(f"(\\d){_G}{{0,2}}Ï"), r"\1π"),
    (re.compile(f"(^|[\\s(,\\[])Ï{_G}{{0,2}}/"), r"\1π/"),
    (re.compile(r"/Ï(?=[\s,.)\]}]|$)"), "/ω"),
    (re.compile("Ï/Ï"), "π/ω"),
    (re.compile(r"([+\-*×÷=/(])Ï(?=[+\-*×÷=/)\s,]|$)"), r"\1π"),
    (re.compile(r"(^|[\s(,])Ï(?=[\s),.]|$)"), r"\1π"),
]


def _entity(m: re.Match) -> str:
    body = m[0][1:-1]
    if body[0] != "#":
        return NAMED_ENTITIES.get(m[0], m[0])
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]


def decode_small_entities(text: str) -> str:
    """The small set of names and numeric references, up to three rounds."""
    for _ in range(3):
        if "&" not in text:
            break
        before, text = text, _ENTITY.sub(_entity, text)
        if before == text:
            break
    return text


def unescape_html(text: str | None) -> str | None:
    return text if not text or "&" not in text else html.unescape(text)


def _bad(text: str, signs: str) -> int:
    return sum(map(text.count, signs))


def undo_misreading(text: str) -> str:
    """A text of Latin-1 characters whose bytes are UTF-8, if that leaves fewer bad signs."""
    if "Ã" not in text and "Â" not in text:
        return text
    try:
        decoded = text.encode("latin-1").decode("utf-8", errors="replace")
    except UnicodeEncodeError:
        return text
    return decoded if _bad(decoded, "\ufffd") < _bad(text, "\ufffdÃÂ") else text


def mojibake_core(text: str | None) -> str | None:
    if not text or text.isascii():
        return text
    text = undo_misreading(text)
    if _FIRST.search(text):
        for key in _BY_LENGTH:
            if key in text:
                text = text.replace(key, MOJIBAKE[key])
    for sign, hidden in _HIDDEN.items():
        text = text.replace(sign, hidden)
    text = re.sub("[\u0080-\u009f\ud800-\udfff]", "", text.replace("\u00a0", " "))
    if "â" in text or "Ï" in text:
        for pattern, to in _CONTEXT:
            text = pattern.sub(to, text)
    for sign, hidden in _HIDDEN.items():
        text = text.replace(sign + sign, sign).replace(hidden + sign, hidden).replace(sign + hidden, hidden).replace(hidden, sign)
    return text


def fix_mojibake(text: str | None) -> str | None:
    return mojibake_core(decode_small_entities(text)) if text else text
