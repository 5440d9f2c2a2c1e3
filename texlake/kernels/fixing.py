"""fix: normalize, canonicalize, wrap what is still bare, merge neighbours."""

from __future__ import annotations

import re

from ..tables import DECLARATION_COMMANDS, SINGLE_LETTER_UNITS, SYMBOL_COMMANDS, TYPOGRAPHIC_SPANS, UNIT_BASES
from .arguments import group_end
from .display import normalize
from .symbols import SYMBOL_COMMAND, Clusters, any_of
from .tokens import map_text, mask, segment
from .write import canonicalize, collapse_double_groups, open_surplus_braces

SUB_DIGITS, RAISED_SIGNS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻"
_SCRIPTS = SUB_DIGITS + RAISED_SIGNS
_ANY_SCRIPT = re.compile(f"[{_SCRIPTS}]")
_PLAIN = str.maketrans(SUB_DIGITS + RAISED_SIGNS, "0123456789" + "0123456789+-")
_CHEMISTRY = re.compile(rf"(?<!\w)[0-9]*[a-z]?(?=[A-Z])[A-Za-z0-9()]*[{_SCRIPTS}][A-Za-z0-9(){_SCRIPTS}]*")
_CHARGE = re.compile("[⁰¹²³⁴⁵⁶⁷⁸⁹]*[⁺⁻]")
_CHEM_PIECE = re.compile(f"(?P<low>[{SUB_DIGITS}]+)|(?P<high>[{RAISED_SIGNS}]+)|(?P<text>[^{_SCRIPTS}]+)")
_POWER = re.compile(rf"(?<!\w)([A-Za-z0-9]+(?:\.[0-9]+)?)([{RAISED_SIGNS}]+|[{SUB_DIGITS}]+)(?![{_SCRIPTS}])")
_BARE = re.compile(r"(?<!\\)" + SYMBOL_COMMAND.pattern)
_STRAY = re.compile(r"(?<![\\$])\$(\\" + any_of(SYMBOL_COMMANDS) + r")\$(?![$A-Za-z])")
_DECLARATION = re.compile(r"\\" + any_of(DECLARATION_COMMANDS) + "(?![A-Za-z])")
_TEXT_OPEN = re.compile(r"\\(?:text|textbf|textit|textrm|textsf|texttt|textnormal|mathrm|mbox)\s*\{")
_PADDED = re.compile(r"(?<![\\$])\$([ \t]*)\\(" + any_of(k[1:] for k in TYPOGRAPHIC_SPANS) + r")([ \t]*)\$(?!\$)")


def unwrap_typographic(text: str) -> str:
    if not any(name in text for name in TYPOGRAPHIC_SPANS):
        return text
    text = "".join(TYPOGRAPHIC_SPANS.get(s.value.strip(), s.raw) if s.math else s.raw for s in segment(text))
    if "$" not in text:
        return text
    inside = mask(text)
    return _PADDED.sub(lambda m: m[0] if inside[m.start()] else m[1] + TYPOGRAPHIC_SPANS["\\" + m[2]] + m[3], text)


def _wrap_symbols(prose: str) -> str:
    prose = _STRAY.sub(r"\1", prose)
    clusters, out, last = Clusters(prose, commands=True), [], 0
    for m in _BARE.finditer(prose):
        if m.start() >= last:
            start, end = clusters.left(m.start(), last), clusters.right(m.start())
            out += [prose[last:start], clusters.span(start, end)]
            last = end
    return "".join([*out, prose[last:]])


def wrap_symbol_commands(text: str) -> str:
    return map_text(text, lambda raw: _wrap_symbols(raw) if "\\" in raw else raw) if "\\" in text else text


def _padded(text: str, start: int, end: int | None, span: str) -> str:
    head = " " if text[start - 1 : start] == "$" and text[start - 2 : start - 1] != "\\" and start else ""
    after = text[end : end + 1] if end is not None else ""
    return head + span + (" " if after == "$" or after.isdigit() else "")


def _chemistry(prose: str) -> str:
    def wrap(m: re.Match) -> str:
        run, tail = m[0], ""
        while run.endswith(")") and run.count(")") > run.count("("):
            run, tail = run[:-1], tail + ")"
        if prose[m.start() - 1 : m.start()] in ("\\", "{") or not (re.search(f"[{SUB_DIGITS}]", run) or _CHARGE.search(run)):
            return m[0]
        form = {"low": "_{%s}", "high": "^{%s}", "text": "\\text{%s}"}
        span = "$" + "".join(form[p.lastgroup] % p[0].translate(_PLAIN) for p in _CHEM_PIECE.finditer(run)) + "$"
        return _padded(prose, m.start(), None if tail else m.end(), span) + tail

    return _CHEMISTRY.sub(wrap, prose)


def wrap_chemistry(text: str) -> str:
    return map_text(text, _chemistry) if _ANY_SCRIPT.search(text) else text


def _powers(prose: str) -> str:
    def wrap(m: re.Match) -> str:
        start, base = m.start(), m[1]
        before = prose[start - 1 : start] if start else ""
        if before and before in "\\{":
            return m[0]
        counted = before == "/" or re.search(r"[0-9][ \t]*$", prose[max(0, start - 64) : start])
        word = base.isalpha() and base.islower() and counted and (len(base) > 1 or base in SINGLE_LETTER_UNITS or before != "/")
        base = f"\\text{{{base}}}" if base in UNIT_BASES or word else base
        mark = "^" if m[2][0] in RAISED_SIGNS else "_"
        return _padded(prose, start, m.end(), f"${base}{mark}{{{m[2].translate(_PLAIN)}}}$")

    return _POWER.sub(wrap, prose)


def wrap_scripts(text: str) -> str:
    return map_text(text, _powers) if _ANY_SCRIPT.search(text) else text


def _specials(body: str) -> str:
    body = re.sub(r"(?<!\\)%", r"\\%", body)
    out, at = [], 0
    for m in _TEXT_OPEN.finditer(body):
        if m.start() >= at and "$" in body:
            close = group_end(body, m.end() - 1)
            close = close if close >= 0 else len(body)
            out += [body[at : m.start()], re.sub(r"(?<!\\)\$", r"\\$", body[m.start() : close])]
            at = close
    return "".join([*out, body[at:]])


def escape_specials(text: str) -> str:
    if "%" not in text and "$" not in text:
        return text
    out = []
    for s in segment(text):
        k = 0 if not s.math else 2 if s.raw.startswith(("$$", "\\")) else 1
        out.append(s.raw[:k] + _specials(s.raw[k:-k]) + s.raw[-k:] if k else s.raw)
    return "".join(out)


def _mergeable(value: str) -> bool:
    depth = 0
    for c in re.findall("[{}]", value):
        depth += 1 if c == "{" else -1
        if depth < 0:
            return False
    return depth == 0 and not _DECLARATION.search(value) and value.count("\\begin{") == value.count("\\end{")


def merge_adjacent(text: str) -> str:
    """Inline spans with nothing or blanks between them become one, if each stands for itself."""
    if text.count("$") < 4:
        return text
    out: list[str] = []
    run: list[str] = []  # bodies of the span being built
    blank, good = "", False

    def flush() -> None:
        nonlocal blank
        if run:
            out.append("$" + " ".join(run) + "$")
            run.clear()
        out.append(blank)
        blank = ""

    for s in segment(text):
        if s.math and not s.display and s.raw[0] == "$":
            fits = _mergeable(s.value)
            if run and good and fits:
                blank = ""
            else:
                flush()
            run.append(s.value)
            good = fits
        elif not s.math and run and not blank and not s.raw.strip(" \t"):
            blank = s.raw
        else:
            flush()
            out.append(s.raw)
    flush()
    return "".join(out)


def fix(text: str | None, chemistry: bool = True) -> str | None:
    if not text:
        return text
    text = canonicalize(unwrap_typographic(normalize(text)), chemistry)
    text = wrap_scripts(wrap_chemistry(wrap_symbol_commands(text)))
    return merge_adjacent(collapse_double_groups(open_surplus_braces(escape_specials(text))))


def needs_fix(text: str | None, chemistry: bool = True) -> bool:
    if not text or text.isascii() and not re.search(r"[\\^_${}%`]", text):
        return False
    return fix(text, chemistry) != normalize(text)
