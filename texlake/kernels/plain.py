"""to_plain: math source as plain Unicode text, in the styles text, pdf, compare and tts."""

from __future__ import annotations

import re
import unicodedata

from ..tables import (
    BINOMIALS,
    COMMAND_TEXT,
    COMPARE_FOLD,
    ELEMENT_SYMBOLS,
    FRACTIONS,
    KNOWN_COMMANDS,
    SCRIPT_LABELS,
    TO_SUBSCRIPT,
    TO_SUPERSCRIPT,
)
from .display import money_positions, trim_padded_keeping_money
from .encoding import fix_mojibake, mojibake_core, unescape_html
from .mend import repair
from .reader import COMMAND, ENVIRONMENT, Reader, table
from .symbols import any_of
from .tokens import mask

STYLES = ("text", "pdf", "tts", "compare")
MAX_DEPTH = 150

# What becomes of commands by kind.
WRAPPERS = frozenset("""
text textit textbf textrm textsf texttt textsc textup textnormal mathrm mathit mathbf mathsf mathtt mathbb mathcal mathfrak mathscr
boldsymbol bm operatorname emph mbox hbox ce boxed fbox cancel bcancel xcancel sout underbrace overbrace pu
""".split())  # fmt: skip
COLOURS = frozenset("color textcolor colorbox".split())
DROPPED_WITH_ARGUMENT = frozenset("hspace vspace phantom hphantom vphantom label tag kern mkern mspace hskip".split())
ACCENTS = {
    "vec": ("\u20d7", "vec"), "overrightarrow": ("\u20d7", "vec"), "overleftarrow": ("\u20d6", "vec"), "hat": ("\u0302", "hat"), "widehat": ("\u0302", "hat"),
    "bar": ("\u0304", "bar"), "overline": ("\u0305", "bar"), "dot": ("\u0307", "dot"), "ddot": ("\u0308", "ddot"), "tilde": ("\u0303", "tilde"), "widetilde": ("\u0303", "tilde"),
}
PLAIN_ACCENTS = frozenset("check breve acute grave underline mathring".split())
SIZES = frozenset("left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr middle".split())
DROPPED = frozenset("hline nonumber notag textstyle scriptstyle displaystyle scriptscriptstyle".split())
BRACKETS = {"vmatrix": "||", "Vmatrix": "‖‖"} | dict.fromkeys("matrix pmatrix bmatrix Bmatrix smallmatrix array".split(), "[]")
TAKE_ARGUMENTS = {*FRACTIONS, *BINOMIALS, *ACCENTS, "sqrt", "begin", "end"} | WRAPPERS | COLOURS | DROPPED_WITH_ARGUMENT | PLAIN_ACCENTS

_RAISED, _LOWERED = str.maketrans(TO_SUPERSCRIPT), str.maketrans(TO_SUBSCRIPT)
_PART = re.compile(r"[0-9]+(?:\.[0-9]+)?|[^\W\d_]")
_SIGNED = re.compile(r"[-−][0-9]+(?:\.[0-9]+)?")
_ONE = re.compile(r"\d+(?:\.\d+)?|.", re.S)


class TooDeep(Exception):
    pass


def in_parentheses(body: str) -> bool:
    """Whether one pair of parentheses holds all of it."""
    depth = 0
    for k, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if depth == 0 and k < len(body) - 1:
            return False
    return body[:1] == "(" and body[-1:] == ")" and depth == 0


def fraction_part(part: str, numerator: bool) -> str:
    core = part.strip()
    bare = numerator and _SIGNED.fullmatch(core) or _PART.fullmatch(core) or in_parentheses(core)
    return core if bare else f"({part})"


def script(body: str, mark: str) -> str:
    body = re.sub(r"\s*([^\w\s])\s*", r"\1", body).strip()
    signs, to = (TO_SUPERSCRIPT, _RAISED) if mark == "^" else (TO_SUBSCRIPT, _LOWERED)
    if not body or mark == "^" and all(c in "°′″‴" for c in body):
        return body
    if all(c in signs for c in body):
        return body.translate(to)
    return mark + body if len(body) == 1 else f"{mark}({body})"


class Plain(Reader):
    """One pass from left to right; arguments are read by a reader of their own."""

    def __init__(self, source: str, accents: bool, depth: int = 0):
        super().__init__(source)
        if depth > MAX_DEPTH:
            raise TooDeep
        self.accents, self.depth, self.out = accents, depth, []

    def read(self, part: str | None) -> str:
        return Plain(part, self.accents, self.depth + 1).convert() if part else ""

    def convert(self) -> str:
        source = self.source
        special = re.compile(r"[\\^_{}]")
        while (m := special.search(source, self.at)) is not None:
            self.out.append(source[self.at : m.start()])
            self.at = m.start()
            sign = m[0]
            if sign == "\\":
                self.backslash()
            elif sign == "{":
                self.out.append(self.read(self.group()))
            elif sign == "}":
                self.at += 1
            else:
                self.script(sign)
        self.out.append(source[self.at :])
        return "".join(self.out)

    def script(self, mark: str) -> None:
        self.at += 1
        first = self.source[self.at : self.at + 1]
        word = COMMAND.match(self.source, self.at)
        if first == "{":
            body = self.group()
        elif word:
            body, self.at = word[0], word.end()
        elif first and (first.isalnum() or first in "+-"):
            body, self.at = first, self.at + 1
        else:
            self.out.append(mark)
            return
        self.out.append(script(self.read(body), mark))

    def backslash(self) -> None:
        word = COMMAND.match(self.source, self.at)
        if word:
            self.at = word.end()
            piece = self.command(word[1])
            if word[1] in FRACTIONS and self.touches_term():
                piece = f"({piece})"
            self.out.append(piece)
            return
        after = self.source[self.at + 1 : self.at + 2]
        if after and after in ",;:> \\":
            self.out.append(" ")
        elif after and after in "%&#_":
            self.out.append(after)
        self.at += 2 if after and after in ",;:> \\%&#_!()[]" else 1

    def touches_term(self) -> bool:
        before = next((p[-1] for p in reversed(self.out) if p), "")
        after = self.source[self.at : self.at + 1]
        if after == "\\" and self.source[self.at + 1 : self.at + 2] in (")", "]"):
            after = ""
        return before.isalnum() or before == "/" or after.isalnum() or bool(after) and after in "(\\^_{"

    def command(self, name: str) -> str:
        if name in FRACTIONS or name in BINOMIALS:
            a, b = self.read(self.argument()), self.read(self.argument())
            return f"{fraction_part(a, True)}/{fraction_part(b, False)}" if name in FRACTIONS else f"C({a}, {b})"
        if name == "sqrt":
            return self.root()
        if name in WRAPPERS:
            return self.read(self.argument())
        if name in COLOURS:
            self.argument()
            return self.read(self.argument()) if self.source[self.skip_blanks() :][:1] == "{" else ""
        if name in DROPPED_WITH_ARGUMENT:
            self.argument()
            return ""
        if name in ACCENTS or name in PLAIN_ACCENTS:
            body = self.read(self.argument())
            if not self.accents or not body or name in PLAIN_ACCENTS:
                return body
            sign, label = ACCENTS[name]
            return body + sign if len(body) == 1 else f"{label}({body})"
        if name in SIZES:
            self.at += self.source[self.at : self.at + 1] == "."
            return ""
        if name in DROPPED:
            return ""
        if name == "begin":
            return self.environment()
        if name == "end":
            self.argument()
            return ""
        if name in COMMAND_TEXT:
            return COMMAND_TEXT[name]
        if name not in KNOWN_COMMANDS:
            for cut in range(len(name) - 1, 1, -1):
                if name[:cut] in COMMAND_TEXT:
                    return COMMAND_TEXT[name[:cut]] + name[cut:]
        return name

    def root(self) -> str:
        sign, index = "√", self.read(self.option()).strip()
        if index:
            sign = index.translate(_RAISED) + "√" if all(c in TO_SUPERSCRIPT for c in index) else f"({index})√"
        body = self.read(self.argument())
        return sign + body if not body or _ONE.fullmatch(body) or in_parentheses(body) else f"{sign}({body})"

    def environment(self) -> str:
        if self.source[self.skip_blanks() :][:1] != "{":
            return ""
        name, start, depth = self.argument().strip(), self.at, 1
        end = self.at = len(self.source)
        for m in ENVIRONMENT.finditer(self.source, start):
            if m[2].strip() == name:
                depth += 1 if m[1] == "begin" else -1
                if depth == 0:
                    end, self.at = m.start(), m.end()
                    break
        return self.rows(name.rstrip("*"), self.source[start:end])

    def rows(self, name: str, body: str) -> str:
        if name == "array":
            head = Reader(body)
            if body[head.skip_blanks() :][:1] == "{":
                head.argument()
                body = body[head.at :]
        rows = [[self.read(c).strip() for c in row] for row in table(body)]
        joined = {"cases": ", "}.get(name, " " if name in BRACKETS else "")
        text = "; ".join(joined.join(c for c in row if c) for row in rows if any(row))
        return BRACKETS[name][0] + text + BRACKETS[name][1] if name in BRACKETS else text


# --- before and after the pass ---------------------------------------------------------------------------------

_ELEMENT = any_of(ELEMENT_SYMBOLS)
_SUB = r"(?:_\{[0-9]+\}|_[0-9]+)"
_ATOM = f"(?:(?>{_ELEMENT}){_SUB}?)"
_FORMULA = re.compile(rf"(?<![A-Za-z0-9_\\])(?>(?:{_ATOM}|\((?>{_ATOM}+)\){_SUB}?)+)(?![A-Za-z0-9_])")
_LOW_DIGITS = str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉")


def bare_chemistry(text: str) -> str:
    """Element symbols with digit subscripts, in prose, by Unicode subscripts."""
    if "_" not in text:
        return text
    inside: list[bool] | None = None

    def write(m: re.Match) -> str:
        nonlocal inside
        if "_" not in m[0]:
            return m[0]
        inside = mask(text) if inside is None else inside
        if inside[m.start()]:
            return m[0]
        return re.sub(r"_\{?([0-9]+)\}?", lambda d: d[1].translate(_LOW_DIGITS), m[0])

    return _FORMULA.sub(write, text)


LEFT, RIGHT, MONEY, LABEL, LABEL_END = "\ue010", "\ue011", "\ue012", "\ue013", "\ue014"
_AMOUNT = re.compile(r"\$[0-9]+(?:[.,][0-9]+)*(?![0-9A-Za-z\\^_{])")
_SPANS = re.compile(r"\$\$[\s\S]+?\$\$|\$[^$]+\$")


def put_amounts_aside(text: str) -> str:
    money = money_positions(text) if "$" in text else []
    if not money:
        return text
    inside, signs = mask(text), list(text)
    for k in money:
        if not inside[k] and _AMOUNT.match(text, k):
            signs[k] = MONEY
    return "".join(signs)


def _command_before(text: str, end: int) -> str | None:
    m = re.search(r"\\([A-Za-z]+)$", text[max(0, end - 64) : end])
    return m[1] if m else None


def keep_prose_braces(text: str) -> str:
    """Braces of sets and objects in prose are text; those of arguments and groups are not."""
    if "{" not in text:
        return text
    hidden = _SPANS.sub(lambda m: "\0" * len(m[0]), text)
    signs, closes = list(text), set()
    partner, stack = {}, []
    for m in re.finditer("[{}]", hidden):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            partner[stack.pop()] = m.start()
    k = hidden.find("{")
    while k >= 0:
        close, before = partner.get(k, -1), text[k - 1] if k else ""
        attached = before and before in "^_" or k - 1 in closes or k and _command_before(text, k) is not None
        if not attached and before == "]":
            o = text.rfind("[", 0, k - 1)
            attached = o > 0 and _command_before(text, o) is not None
        elif not attached and before and before in " \t":
            attached = _command_before(text, len(text[:k].rstrip(" \t"))) in TAKE_ARGUMENTS
        at = k + 1
        if attached:
            if close < 0:
                break
            closes.add(close)
            at = close + 1
        elif close < 0:
            signs[k] = LEFT
        elif close - k > 2 and re.search("[,:;|]", text[k + 1 : close]):
            signs[k], signs[close] = LEFT, RIGHT
        else:
            at = close + 1
        k = hidden.find("{", at)
    return "".join(signs)


_CUT_OFF = re.compile(r"\\\$(?=[0-9]+(?:[.,][0-9]+)*(?:[A-Za-z^_{]|\\[A-Za-z]))")


def latex_to_plain(text: str, accents: bool = False, label_backslash: bool = True, compare: bool = False) -> str:
    if not compare and not re.search(r"[$\\{]", text):
        return text
    images: list[str] = []
    labels: list[str] = []

    def image(m: re.Match) -> str:
        images.append(m[0])
        return f"\0IMG{len(images) - 1}\0"

    def label(m: re.Match) -> str:
        if not m[1] and m[2] not in SCRIPT_LABELS:
            return m[0]
        labels.append(m[2])
        return f"{m[1] or ''}{LABEL}{len(labels) - 1}{LABEL_END}:"

    text = put_amounts_aside(re.sub(r"\{\{IMAGE:[^}]+\}\}", image, text))
    text = _CUT_OFF.sub("", text) if compare else text
    text = re.sub(r"\\n(?=[A-Z\s]|$)", "\n", text)
    text = text.replace("\\$", MONEY).replace("\\{", LEFT).replace("\\}", RIGHT)
    if "\\" in text and ":" in text:
        # at a line's start any lower-case word is a label; elsewhere only a known one
        text = re.sub(r"(?m)(?:(^[ \t]*)|)\\([a-z][a-z_]*):", lambda m: label(m) if m[1] is None else _line_label(m, labels), text)
    text = keep_prose_braces(text)
    text = re.sub(r"\$\$(.+?)\$\$", r"\1", text, flags=re.S)
    text = re.sub(r"\$([^$]+)\$", r"\1", text)
    try:
        text = Plain(text, accents).convert()
    except TooDeep:
        text = re.sub(r"\\[A-Za-z]+|[{}]", "", text)
    text = re.sub(r"[ \t]{2,}", " ", text)
    if text.count("$") % 2:
        text = text[1:] if text[0] == "$" else text[:-1] if text[-1] == "$" else text
    text = text.replace("$", "") if compare else text
    text = text.replace(LEFT, "{").replace(RIGHT, "}").replace(MONEY, "$")
    for k, name in enumerate(labels):
        text = text.replace(f"{LABEL}{k}{LABEL_END}", ("\\" if label_backslash else "") + name)
    for k, marker in enumerate(images):
        text = text.replace(f"\0IMG{k}\0", marker)
    return unicodedata.normalize("NFC", text)


def _line_label(m: re.Match, labels: list[str]) -> str:
    labels.append(m[2])
    return f"{m[1]}{LABEL}{len(labels) - 1}{LABEL_END}:"


_OPTION = re.compile(r"^\s*(?:\([A-Ha-h]\)|[A-Ha-h][).:])\s+(?=\S)")
_SUPER_BACK = {v: k for k, v in TO_SUPERSCRIPT.items()}
_SUB_BACK = {v: k for k, v in TO_SUBSCRIPT.items()}


def fold_for_compare(text: str) -> str:
    option = _OPTION.match(text)
    if option and not re.fullmatch(r"[A-Za-z]\s*", text[option.end() :]):
        text = text[option.end() :]
    out = ""
    if not text.isascii():
        for c in text:
            to = COMPARE_FOLD.get(c, c)
            if to is not c and re.match("[0-9][^/]*/", to) and re.search("[0-9]$", out[-1:]):
                to = " " + to
            out += to
        text = out
        for back, mark in ((_SUPER_BACK, "^"), (_SUB_BACK, "_")):
            run = re.compile("[" + re.escape("".join(back)) + "]+")
            text = run.sub(lambda m, b=back, s=mark: s + "".join(b[c] for c in m[0]), text)
    return re.sub(r" ?([+\-*/=<>^_(),{}\[\]]) ?", r"\1", re.sub(r"\s+", " ", text).strip())


def to_plain(text: str | None, style: str = "text") -> str | None:
    if style not in STYLES:
        raise ValueError(f"style {style!r} is none of {STYLES}")
    if text is None:
        return None
    text = repair(text)
    text = mojibake_core(unescape_html(text)) if style == "compare" else fix_mojibake(text)
    text = trim_padded_keeping_money(text)
    if style == "tts":
        from .spoken import to_spoken

        return to_spoken(text)
    if style == "compare":
        return fold_for_compare(latex_to_plain(text, label_backslash=False, compare=True))
    return latex_to_plain(bare_chemistry(text), accents=style == "pdf", label_backslash=style == "text")
