"""Forms of a text for particular renderers, and mhchem bodies as plain commands."""

from __future__ import annotations

import re

from .arguments import group_end
from .tokens import partners, segment, signs_of

ESCAPED_DOLLAR = ""
OPERATOR_STAR = ""
#: Math that a renderer left as source: a span with a command, or an opener.
RAW_MATH = r"\$[^$\n]*\\[a-zA-Z]+[^$\n]*\$|\\\(|\\\["


def mask_escaped_dollars(text: str) -> str:
    """Every escaped dollar of the prose under a private sign; math stays, and all behind an unclosed opener."""
    at, signs = signs_of(text)
    closing, out, begun, k = partners(text, at, signs), [], 0, 0
    while k < len(at):
        if signs[k] == "\\$":
            out += [text[begun : at[k]], ESCAPED_DOLLAR]
            begun = at[k] + 2
        elif signs[k] in ("$", "\\[", "\\("):
            if closing[k] < 0:
                break
            k = closing[k] + text.startswith("$$", at[k])
        k += 1
    return "".join([*out, text[begun:]])


def _brackets(text: str) -> list[tuple[str, bool]]:
    """(piece, whether it is prose), math between brackets."""
    if "$" not in text:
        return [(text, True)]
    edges = {True: ("\\[", "\\]"), False: ("\\(", "\\)")}
    return [(edges[s.display][0] + s.value + edges[s.display][1], False) if s.math else (s.value, True) for s in segment(text)]


def to_bracket_delimiters(text: str) -> str:
    return "".join(piece for piece, _ in _brackets(text))


_LONE_STAR = re.compile(r"(?<=[^\s*][ \t])(?<!\*)\*(?!\*)(?=[ \t]+[^\s])|(?<=[ \t])\*(?!\*)(?=[ \t]+[^\s])")


def to_markdown_source(text: str) -> str:
    """Brackets for math, and a stand-in for stars of the prose that stand between spaced operands."""
    pieces = _brackets(text)
    whole = "".join(p for p, _ in pieces)
    prose = [kind for p, kind in pieces for _ in p]

    def star(m: re.Match) -> str:
        line = whole[whole.rfind("\n", 0, m.start()) + 1 : m.start()]
        return OPERATOR_STAR if prose[m.start()] and line.strip(" \t") else m[0]

    return _LONE_STAR.sub(star, whole)


# --- mhchem ------------------------------------------------------------------------------------------------------------

#: Reaction arrows, plain and with a label.
ARROWS = {"<=>": ("\\rightleftharpoons", "\\xrightleftharpoons"), "<->": ("\\leftrightarrow", "\\xleftrightarrow"), "->": ("\\rightarrow", "\\xrightarrow"), "<-": ("\\leftarrow", "\\xleftarrow")}
_OPEN = re.compile(r"(?<!\\)\\(ce|pu)(?![A-Za-z])\s*\{")
TOKEN = re.compile(
    r"(?P<blank>\s)|(?P<arrow><=>|<->|->|<-)|(?P<sign>[+-])|(?P<script>[\^_])|(?P<letters>[A-Za-z]+)|(?P<number>[0-9]+)"
    r"|(?P<open>[(\[])|(?P<close>[)\]])|(?P<dot>[*·•])|(?P<double>=)|(?P<triple>\#)|(?P<command>\\[A-Za-z]+)"
)
SCRIPT = re.compile(r"[0-9]+[+-]?|[+-]|[A-Za-z]")
_COEFFICIENT = re.compile(r"[0-9./]+")


class _Formula:
    """Output of a formula, and what the next script can attach to."""

    def __init__(self):
        self.out: list[str] = []
        self.base, self.taken = False, set()

    def put(self, piece: str, base: bool = False) -> None:
        self.out.append(piece)
        self.base, self.taken = base, set()

    def attach(self, mark: str, content: str) -> None:
        if not self.base:
            self.put("{}", base=True)
        if mark in self.taken:
            self.put("{}", base=True)
        self.out.append(f"{mark}{{{content}}}")
        self.taken.add(mark)


def ce_to_latex(body: str) -> str | None:
    """The body of a chemical formula or reaction as plain commands; None outside the grammar."""
    body = body.strip()
    formula, at = _Formula(), 0
    simple = {"open": False, "close": True}
    fixed = {"blank": " ", "dot": " \\cdot ", "double": "=", "triple": "\\equiv "}
    while at < len(body):
        m = TOKEN.match(body, at)
        if not m:
            return None
        kind, sign, at = m.lastgroup, m[0], m.end()
        if kind in fixed:
            formula.put(fixed[kind])
        elif kind in simple:
            formula.put(sign, base=simple[kind])
        elif kind == "letters":
            formula.put(f"\\mathrm{{{sign}}}", base=True)
        elif kind == "command":
            formula.put(sign + " ")
        elif kind == "number":
            if formula.base:
                formula.attach("_", sign)
            else:
                at = _COEFFICIENT.match(body, m.start()).end()
                formula.put(body[m.start() : at])
        elif kind == "sign":
            after = body[at : at + 1]
            if formula.base and (not after or after.isspace() or after in ")]"):
                formula.attach("^", sign)
            else:
                formula.put("-" if sign == "-" and formula.base else f" {sign} ")
        elif kind == "script":
            found = group_end(body, at) if body[at : at + 1] == "{" else -1
            plain = SCRIPT.match(body, at)
            if found < 0 and not plain:
                return None
            content, at = (body[at + 1 : found - 1], found) if found >= 0 else (plain[0], plain.end())
            formula.attach(sign, content)
        else:
            labels = []
            while len(labels) < 2 and body[at : at + 1] == "[":
                close = body.find("]", at)
                if close < 0:
                    return None
                label = body[at + 1 : close].strip()
                labels.append((ce_to_latex(label) or f"\\text{{{label}}}") if label else "")
                at = close + 1
            plain, labelled = ARROWS[sign]
            below = f"[{labels[1]}]" if len(labels) == 2 else ""
            formula.put(f" {labelled}{below}{{{labels[0]}}} " if labels else f" {plain} ")
    return re.sub(" {2,}", " ", "".join(formula.out)).strip() or None


_NUMBER = re.compile(r"([-+]?\d+(?:\.\d+)?)(?:[eE]\+?(-?\d+))?")
_UNIT = re.compile(r"(?P<word>[A-Za-z/%µμΩ]+)|(?P<degree>°)|\^?\{(?P<group>[^{}]*)\}|\^?\+?(?P<power>-?[0-9]+)|(?P<dot>[.*·])")
_UNIT_SIGNS = str.maketrans({"%": "\\%", "µ": "\\mu ", "μ": "\\mu ", "Ω": "\\Omega "})


def _unit(token: str) -> str | None:
    out, at = "", 0
    while at < len(token):
        m = _UNIT.match(token, at)
        if not m:
            return None
        at = m.end()
        if m["word"]:
            out += f"\\mathrm{{{m['word'].translate(_UNIT_SIGNS)}}}"
        elif m["degree"]:
            out += "{}^{\\circ}"
        elif m["dot"]:
            out += "\\cdot "
        elif not out:
            return None
        else:
            power = m["group"] if m["group"] is not None else m["power"]
            out += f"^{{{power.removeprefix('+')}}}"
    return out or None


def pu_to_latex(body: str) -> str | None:
    """A quantity with its units as plain commands; None outside the grammar."""
    body = body.strip()
    number = _NUMBER.match(body)
    parts = []
    if number:
        parts.append(number[1] + (f"\\times10^{{{number[2]}}}" if number[2] else ""))
        body = body[number.end() :].strip()
    for token in body.split():
        unit = _unit(token)
        if unit is None:
            return None
        parts.append(unit)
    return "\\ ".join(parts) or None


def ce_in_text(text: str) -> str:
    """Every formula and quantity of a math source that is understood, as a group of plain commands."""
    out, at = [], 0
    for m in _OPEN.finditer(text):
        end = group_end(text, m.end() - 1)
        if m.start() < at or end < 0:
            continue
        body = text[m.end() : end - 1]
        plain = ce_to_latex(body) if m[1] == "ce" else pu_to_latex(body)
        if plain is not None:
            out += [text[at : m.start()], "{" + plain + "}"]
            at = end
    return "".join([*out, text[at:]])
