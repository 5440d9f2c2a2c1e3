"""Native predicates that hold wherever a kernel may change a text, so that other rows never reach Python.

Each is a superset: ``not gate(x)`` implies that the function leaves ``x`` as it is. They are plain regular
expressions without unbounded alternation groups, which Java would match by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column

from ..tables import BEHIND_JSON_ESCAPES, HOMOGLYPHS, MOJIBAKE, SCRIPT_LABELS, UNICODE_MATH


def _soft() -> str:
    """White space that spells a command or a label, or a control character that is always dropped.

    One class comes first, so that most characters fail on a single test.
    """
    parts = [r"(?<![\t\n\r])"]
    for letter, sign in (("t", "\\t"), ("n", "\\n"), ("r", "\\r")):
        runs = sorted(w[1:] for w in BEHIND_JSON_ESCAPES if w[0] == letter)
        labels = sorted(w[1:] + ":" for w in SCRIPT_LABELS if w[0] == letter)
        parts.append(f"(?<={sign})(?:(?:{'|'.join(runs)})(?![A-Za-z])" + "".join(f"|{x}" for x in labels) + ")")
    return r"[\x00-\x1f\x7f](?:" + "|".join(parts) + ")"


REPAIR = _soft()
IN_SPAN = r"[\t\n\r][A-Za-z]{3}"
MISREAD = f"[\\x80-\\xa0{''.join(sorted({k[0] for k in MOJIBAKE}))}]"


def _other_than_letters(needed) -> str:
    """All characters but ASCII, letters of common scripts and quotes.

    Java tests a class member by member, so naming the signs themselves would cost hundreds of tests a character.
    This tests one range, and a few more behind it for characters that are not ASCII.
    """
    needed, parts = {ord(c) for c in needed}, []
    for low, high in ((0x80, 0x24F), (0x400, 0x1CFF), (0x2013, 0x201F), (0x2E80, 0xD7FF), (0xF900, 0xFAFF), (0xFE00, 0xFFEF)):
        start = low
        for cp in [*sorted(c for c in needed if low <= c <= high), high + 1]:
            if cp > start:
                parts.append(f"\\x{{{start:x}}}-\\x{{{cp - 1:x}}}")
            start = cp + 1
    return "[^\\x00-\\x7f](?<![" + "".join(parts) + "])"


MATH_SIGNS = _other_than_letters([*UNICODE_MATH, *HOMOGLYPHS, "\u20d7"])
AUDITED = f"[\\\\{{\\x{{fffd}}âÂÃÎÏ$]|{MATH_SIGNS}"  # no brace behind the dollar: SQL would read a variable


def _misread(c: Column) -> Column:
    return c.rlike(MISREAD) | (c.contains("&") & c.rlike("&[#A-Za-z]"))


def repair(c: Column) -> Column:
    return c.rlike(REPAIR) | (c.contains("$") & c.rlike(IN_SPAN))


def normalize(c: Column) -> Column:
    return c.rlike(r"[\\$]") | c.rlike(REPAIR) | _misread(c)


def normalize_code(c: Column) -> Column:
    return normalize(c) | c.contains("`")


def fix(c: Column) -> Column:
    return c.rlike(r"[\\$^_{}]") | c.rlike(MATH_SIGNS) | c.rlike(REPAIR) | _misread(c)


def plain(c: Column) -> Column:
    return c.rlike(r"[\\${_]") | c.rlike(REPAIR) | _misread(c)


def encoding(c: Column) -> Column:
    return _misread(c)


def audit(c: Column) -> Column:
    return c.rlike(AUDITED) | c.rlike(REPAIR)


def segments(c: Column) -> Column:
    return c.rlike(r"[\\$]")


def money(c: Column) -> Column:
    return c.rlike("[$₹€£¥]")


def backslash(c: Column) -> Column:
    return c.contains("\\")


#: Answers that the fold for comparison reads without any notation: only blanks around operators go.
_ANSWER, _LABEL = r"[^A-Za-z0-9 +/=,.()<>*-]", r"^ *\(?[A-Ha-h][).:] "


def answer(c: Column) -> Column:
    return c.rlike(_ANSWER) | c.rlike(_LABEL)


def spoken(c: Column) -> Column:
    return c.rlike(r"[^A-Za-z0-9 .,!?'():;/=+-]|  |^ | $")


def document(c: Column) -> Column:
    """Texts that ``audit`` looks into, and those that may be JSON documents."""
    return audit(c) | c.rlike(r"^\s*[\[{]")
