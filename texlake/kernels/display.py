"""normalize: content-preserving repairs before display."""

from __future__ import annotations

import re

from ..tables import CURRENCY_SYMBOLS, KNOWN_COMMANDS, PROSE_COMMANDS, STOP_WORDS, TEXT_FAMILY, UNICODE_MATH
from .arguments import lacks_argument
from .encoding import fix_mojibake
from .mend import repair
from .tokens import backslashes_before, between, escaped, map_text, mask

_ORPHAN = re.compile(r"(?<!\\)\\[()\[\]]")
_NAME = re.compile(r"\\[A-Za-z]+")


def normalize_delimiters(text: str) -> str:
    text = between(text, "\\[", "\\]", lambda body: f"$${body}$$")
    return between(text, "\\(", "\\)", lambda body: "$" + re.sub(r"[ \t]*\n\s*", " ", body).strip() + "$")


def strip_orphans(text: str) -> str:
    return _ORPHAN.sub("", text)


def is_formula(content: str) -> bool:
    """A formula rather than prose between two amounts: signs of formulas only, no word, an operator, a letter."""
    core = content.rstrip(" \t")
    bare = _NAME.sub(" ", core)
    command = bare != core
    if not core or not re.fullmatch(r"[0-9A-Za-z+\-*/=<>().,^_ \t]+", bare) or re.search("[A-Za-z]{2}", bare):
        return False
    if not command and not (re.search(r"[+\-*/=<>^_]", bare) and re.search("[A-Za-z]", bare)):
        return False
    return not lacks_argument(f"${core}$")


def _money_in_line(line: str) -> list[int]:
    marks = [m.start() for m in re.finditer(r"(?<!\\)\$", line)]
    found, at = [], 0  # ``at``: next character that may open
    index = 0
    while index < len(marks):
        k = marks[index]
        if k < at:
            index += 1
            continue
        if line.startswith("$$", k):
            close = line.find("$$", k + 2)
            at = len(line) if close < 0 else close + 2
            continue
        later = marks[index + 1] if index + 1 < len(marks) else -1
        if not ("0" <= line[k + 1 : k + 2] <= "9"):
            at = later + 1 if later >= 0 else k + 1
            continue
        closes = later >= 0 and not ("0" <= line[later + 1 : later + 2] <= "9") and (line[later - 1] not in " \t" or is_formula(line[k + 1 : later]))
        if not closes:
            found.append(k)
        at = later + 1 if closes else k + 1
    return found


def money_positions(text: str) -> list[int]:
    """Dollars that open an amount rather than a span, line by line."""
    out, base = [], 0
    if "$" in text:
        for line in text.split("\n"):
            if "$" in line:
                out += [base + k for k in _money_in_line(line)]
            base += len(line) + 1
    return out


def escape_currency(text: str) -> str:
    out, last = [], 0
    for k in money_positions(text):
        out += [text[last:k], "\\"]
        last = k
    return "".join([*out, text[last:]])


_AMOUNT = re.compile(r"[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?")


def currency_spans(text: str | None) -> list[tuple[int, int, str]]:
    if not text:
        return []
    out, money = [], set(money_positions(text))
    for m in re.finditer(f"[${CURRENCY_SYMBOLS}]", text):
        k = start = m.start()
        if m[0] == "$":
            if backslashes_before(text, k) % 2:
                start = k - 1
            elif k not in money:
                continue
            at = k + 1
        else:
            at = k + 2 if re.match("[ \u00a0][0-9]", text[k + 1 : k + 3]) else k + 1
        amount = _AMOUNT.match(text, at)
        if amount:
            out.append((start, amount.end(), text[start : amount.end()]))
    return out


_TEXT_GROUP = re.compile(r"\\(?:" + "|".join(TEXT_FAMILY) + r")\s*\{[^{}]*\}")
_SIGN = re.compile("[" + re.escape("".join(UNICODE_MATH)) + "]")


def has_prose(content: str) -> bool:
    """A word of four letters or a stop word outside text groups and command names."""
    words = _NAME.sub("", _TEXT_GROUP.sub("", content))
    return bool(re.search("[A-Za-z]{4,}", words)) or any(w.lower() in STOP_WORDS for w in re.findall(r"(?<![A-Za-z])[A-Za-z]{1,3}(?![A-Za-z])", words))


def padded_math(core: str) -> bool:
    strong = re.search(r"\\[A-Za-z]|[\^_]", core) or _SIGN.search(core)
    if not strong and ("=" not in core or core[0].isdigit()):
        return False
    return not lacks_argument(f"${core}$") and not has_prose(core)


def _trim_line(line: str) -> str:
    if "$$" in line:
        return line
    marks = [m.start() for m in re.finditer(r"\$", line) if not escaped(line, m.start())]
    if len(marks) % 2:
        return line
    out, last = [], 0
    for a, b in zip(marks[::2], marks[1::2], strict=True):
        inner = line[a + 1 : b]
        core = inner.strip(" \t")
        glued = line[b + 1 : b + 2].isalnum() or line[a - 1 : a].isalnum()
        if core and core != inner and not glued and (padded_math(core) or is_formula(core)):
            out += [line[last:a], f"${core}$"]
            last = b + 1
    return "".join([*out, line[last:]])


def trim_padded(text: str) -> str:
    if not re.search(r"\$[ \t]|[ \t]\$", text):
        return text
    return map_text(text, lambda raw: "\n".join(map(_trim_line, raw.split("\n"))) if raw.count("$") > 1 else raw)


_MONEY = "\ue000"


def trim_padded_keeping_money(text: str) -> str:
    if "$" not in text or _MONEY in text:
        return text
    signs = list(text)
    for k in money_positions(text):
        signs[k] = _MONEY
    return trim_padded("".join(signs)).replace(_MONEY, "$")


_SPAN = re.compile(r"\$\$[\s\S]*?\$\$|(?<!\\)\$(?:\\.|[^$\n\\])+\$")
_ESCAPE = re.compile(r"\\r\\n|\\[nrt]")
_LABEL = re.compile(r"\\[a-z][a-z_]*:")
_WORD = re.compile(r"\\([A-Za-z]+)")


def _decode_prose(prose: str) -> str:
    def decode(m: re.Match) -> str:
        word = _WORD.match(prose, m.start())
        if word and word[1] in PROSE_COMMANDS or _LABEL.match(prose, m.start()):
            return m[0]
        return "\t" if m[0] == "\\t" else "\n"

    return _ESCAPE.sub(decode, prose)


def decode_escapes_outside_math(text: str) -> str:
    if not _ESCAPE.search(text):
        return text
    kept = mask(text)
    for m in _SPAN.finditer(text):
        kept[m.start() : m.end()] = [True] * (m.end() - m.start())
    out, begun = [], 0
    for k in range(1, len(text) + 1):
        if k == len(text) or kept[k] != kept[begun]:
            out.append(text[begun:k] if kept[begun] else _decode_prose(text[begun:k]))
            begun = k
    return "".join(out)


_TICKS = re.compile(r"(`+)")


def _code_is_math(body: str) -> bool:
    if not body or body != body.strip() or "$" in body or "\n" in body:
        return False
    names = _WORD.findall(body)
    bare = _NAME.sub(" ", body)
    if any(n not in KNOWN_COMMANDS for n in names) or not (names or "^" in body or "_" in body):
        return False
    if not re.fullmatch(r"[0-9A-Za-z+\-*/=<>()\[\]{}.,^_ \t|!']*", bare) or re.search("[A-Za-z]{3}", bare):
        return False
    return bool(names) or "{" in body or "^" in body or body.count("_") < 2 and len(body.split("_")[0]) < 2


def code_spans_to_math(text: str) -> str:
    """Inline code whose body is clearly maths becomes a span."""
    out, at = [], 0
    while (m := _TICKS.search(text, at)) is not None:
        out.append(text[at : m.start()])
        at = m.end()
        close = text.find("`", at) if len(m[1]) == 1 else -1
        body = text[at:close]
        after = text[close + 1 : close + 2]
        if close >= 0 and after != "`" and not ("0" <= after <= "9") and _code_is_math(body):
            out.append(f"${body}$")
            at = close + 1
        else:
            out.append(m[1])
    return "".join([*out, text[at:]])


def normalize(text: str | None, code_spans_as_math: bool = False) -> str | None:
    if not text:
        return text
    text = fix_mojibake(repair(text))
    if code_spans_as_math:
        text = code_spans_to_math(text)
    if "\\" in text:
        text = strip_orphans(normalize_delimiters(text))
    if "$" in text:
        text = trim_padded(escape_currency(text))
    return decode_escapes_outside_math(text) if "\\" in text else text
