"""Functions of text columns. A null text gives null, or an empty array or false where the result is one."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import adapters, display, encoding, findings, fixing, mend, options, plain, symbols, tokens, transport, write
from ..plans import gates
from ..plans.kernels import gated, kernel
from ..tables import FILE_EXTENSIONS, HOMOGLYPHS, KNOWN_COMMANDS, NON_CONTENT_KEYS, NON_CONTENT_SUFFIXES, NOT_RENDERED_KEYS, URL_PREFIXES

SEGMENT = "struct<kind string, display boolean, value string, raw string>"
FINDING = "struct<kind string, position int, snippet string>"
SPAN = "struct<start int, end int, text string>"
RANGE = "struct<start int, end int, display boolean>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rows(values) -> list[dict]:
    return [v._asdict() for v in values]


# --- tokenizer ---------------------------------------------------------------------------------------------------


def _segments(text):
    return _rows(tokens.segment(text))


def segment(c) -> Column:
    """Text and math segments; texts without a dollar or backslash are one text segment and stay in the JVM."""
    c = _col(c)
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(False).alias("display"), c.alias("value"), c.alias("raw")))
    none = F.array().cast(f"array<{SEGMENT}>")
    read = kernel(_segments, f"array<{SEGMENT}>")(F.when(gates.segments(c), c))
    return F.when(c.isNull() | (c == ""), none).when(gates.segments(c), read).otherwise(whole.cast(f"array<{SEGMENT}>"))


def contains_math(c) -> Column:
    c = _col(c)
    return F.coalesce(c.rlike(r"\\[A-Za-z]") | F.exists(segment(c), lambda s: s["kind"] == "math"), F.lit(False))


def is_plain_prose(c) -> Column:
    return F.coalesce(~_col(c).rlike("(?dU)" + tokens.NOT_PLAIN), F.lit(False))


def math_ranges(c) -> Column:
    """(start, end, display) of math segments, by code points, from the lengths of the segments before them."""

    def step(acc, s):
        end = acc["at"] + F.length(s["raw"])
        found = F.struct(acc["at"].alias("start"), end.alias("end"), s["display"].alias("display"))
        grown = F.when(s["kind"] == "math", F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{RANGE}>").alias("out"))
    return F.aggregate(segment(c), start, step, lambda acc: acc["out"])


# --- repair and normalize ---------------------------------------------------------------------------------------


def _v_commands() -> str:
    return "|".join(sorted((w[1:] for w in KNOWN_COMMANDS if w[0] == "v" and len(w) > 1), key=lambda w: (-len(w), w)))


def repair(c, guess_whitespace: bool = True) -> Column:
    """The read-path form (no guess) is native; the other one is a kernel behind its gate."""
    c = _col(c)
    if guess_whitespace:
        return gated(c, mend.repair, gates.repair)
    out = F.regexp_replace(c, mend.ANSI, "")
    out = F.regexp_replace(out, r"\x08(?=\p{L})", r"\\b")
    out = F.regexp_replace(out, r"\x0c(?=\p{L})", r"\\f")
    out = F.regexp_replace(out, rf"\x0b(?=(?:{_v_commands()})(?![A-Za-z]))", r"\\v")
    return F.regexp_replace(out, mend.DROPPED, "")


def normalize(c, code_spans_as_math: bool = False) -> Column:
    return gated(_col(c), partial(display.normalize, code_spans_as_math=code_spans_as_math), gates.normalize_code if code_spans_as_math else gates.normalize)


def normalize_delimiters(c) -> Column:
    return gated(_col(c), display.normalize_delimiters, gates.backslash)


def strip_orphan_delimiters(c) -> Column:
    return F.regexp_replace(_col(c), r"(?<!\\)\\[()\[\]]", "")


def escape_currency(c) -> Column:
    return gated(_col(c), display.escape_currency, gates.money)


def trim_padded_spans(c) -> Column:
    return gated(_col(c), display.trim_padded, gates.money)


def decode_escapes_outside_math(c) -> Column:
    return gated(_col(c), display.decode_escapes_outside_math, gates.backslash)


def code_spans_to_math(c) -> Column:
    return gated(_col(c), display.code_spans_to_math, lambda x: x.contains("`"))


def is_formula(c) -> Column:
    return F.coalesce(kernel(_is_formula, "boolean")(_col(c)), F.lit(False))


def _is_formula(text):
    return text is not None and display.is_formula(text)


def currency_positions(c) -> Column:
    return F.coalesce(kernel(_money, "array<int>")(F.when(_col(c).contains("$"), _col(c))), F.array().cast("array<int>"))


def _money(text):
    return None if text is None else display.money_positions(text)


def _spans(text):
    return None if text is None else [{"start": s, "end": e, "text": t} for s, e, t in display.currency_spans(text)]


def currency_spans(c) -> Column:
    c = _col(c)
    return F.coalesce(kernel(_spans, f"array<{SPAN}>")(F.when(gates.money(c), c)), F.array().cast(f"array<{SPAN}>"))


def fix_mojibake(c) -> Column:
    return gated(_col(c), encoding.fix_mojibake, gates.encoding)


def fix_mojibake_core(c) -> Column:
    return gated(_col(c), encoding.mojibake_core, gates.encoding)


def unescape_html(c) -> Column:
    return gated(_col(c), encoding.unescape_html, lambda x: x.contains("&"))


# --- canonicalize and fix ---------------------------------------------------------------------------------------


def normalize_homoglyphs(c) -> Column:
    return F.translate(_col(c), "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def canonicalize(c, chemistry: bool = True) -> Column:
    """For text that is written, never for text that is only read."""
    return gated(_col(c), partial(write.canonicalize, chemistry=chemistry), gates.fix)


def fix(c, chemistry: bool = True) -> Column:
    return gated(_col(c), partial(fixing.fix, chemistry=chemistry), gates.fix)


def needs_fix(c, chemistry: bool = True) -> Column:
    c = _col(c)
    return F.coalesce(kernel(partial(fixing.needs_fix, chemistry=chemistry), "boolean")(F.when(gates.fix(c) | c.contains("%"), c)), F.lit(False))


def normalize_option_text(c, chemistry: bool = True) -> Column:
    return gated(_col(c), partial(options.normalize_option_text, chemistry=chemistry), gates.fix)


#: Single steps of the chains above, by name.
STEPS = {
    "unwrap_typographic_spans": fixing.unwrap_typographic,
    "wrap_bare_symbol_commands": fixing.wrap_symbol_commands,
    "wrap_unicode_chemistry": fixing.wrap_chemistry,
    "wrap_unicode_scripts": fixing.wrap_scripts,
    "escape_text_specials": fixing.escape_specials,
    "merge_adjacent_math": fixing.merge_adjacent,
    "unicode_math_to_latex": symbols.math_to_commands,
    "convert_combining_vec": symbols.convert_combining_vec,
    "wrap_bare_unicode_math": symbols.wrap_bare_unicode,
    "unescape_math_opener": write.unescape_math_opener,
    "collapse_double_backslashes": write.collapse_backslashes,
    "fix_command_typos": write.fix_typos,
    "fix_left_right_braces": write.fix_delimiter_braces,
    "close_unbalanced_braces": write.close_braces,
    "open_surplus_braces": write.open_surplus_braces,
    "collapse_double_groups": write.collapse_double_groups,
    "replace_angstrom": write.replace_angstrom,
    "drop_orphan_dollar": write.drop_orphan_dollar,
    "normalize_braces": write.brace_scripts,
    "wrap_bare_latex_commands": write.wrap_bare_commands,
    "wrap_bare_scripts": write.wrap_bare_scripts,
    "wrap_pure_math_short_strings": write.wrap_pure_math,
    "bare_chemistry_to_unicode": plain.bare_chemistry,
}


def step(name: str, c) -> Column:
    """One step of a chain over a column: ``step("merge_adjacent_math", "text")``."""
    return gated(_col(c), STEPS[name], lambda x: x.rlike(r"[\\$^_{}%]") | x.rlike(gates.MATH_SIGNS))


def greek_word_at(c, k: int) -> Column:
    """(start, end) of the Greek word around code point k, or null."""
    return kernel(partial(_greek_word, k=k), "struct<start int, end int>")(_col(c))


def _greek_word(text, k):
    found = symbols.Clusters(text, tokens.mask(text)).word(k) if text and 0 <= k < len(text) else None
    return {"start": found[0], "end": found[1]} if found else None


# --- plain text, audit, transport -------------------------------------------------------------------------------


def to_plain(c, style: str = "text") -> Column:
    if style not in plain.STYLES:
        raise ValueError(f"style {style!r} is none of {plain.STYLES}")
    if style == "compare":
        return compare_key(c)
    return gated(_col(c), partial(plain.to_plain, style=style), gates.spoken if style == "tts" else gates.plain)


def compare_key(c) -> Column:
    """Two answers are equal if and only if their keys are. Answers without notation are folded in the JVM."""
    c = _col(c)
    return F.when(gates.answer(c), kernel(partial(plain.to_plain, style="compare"))(F.when(gates.answer(c), c))).otherwise(folded_answer(c))


def folded_answer(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, " +", " ")), " ?([-+*/=<>(),]) ?", "$1")


def _findings(text):
    return None if text is None else _rows(findings.audit(text))


def audit(c) -> Column:
    c = _col(c)
    return F.coalesce(kernel(_findings, f"array<{FINDING}>")(F.when(gates.audit(c), c)), F.array().cast(f"array<{FINDING}>"))


def audit_kinds(c) -> Column:
    c = _col(c)
    return F.coalesce(kernel(_kinds, "array<string>")(F.when(gates.audit(c), c)), F.array().cast("array<string>"))


def _kinds(text):
    return None if text is None else findings.audit_kinds(text)


def is_error(kinds) -> Column:
    return F.arrays_overlap(_col(kinds), F.array(*map(F.lit, findings.ERROR_KINDS)))


def unescaped_dollars(c) -> Column:
    return F.regexp_count(_col(c), F.lit(r"(?<!\\)\$"))


def escape_latex_for_json(c) -> Column:
    return gated(_col(c), transport.escape_latex_for_json, gates.backslash)


# --- forms for renderers ------------------------------------------------------------------------------------------


def mask_escaped_dollars(c) -> Column:
    return gated(_col(c), adapters.mask_escaped_dollars, lambda x: x.contains("\\$"))


def to_bracket_delimiters(c) -> Column:
    return gated(_col(c), adapters.to_bracket_delimiters, lambda x: x.contains("$"))


def to_markdown_source(c) -> Column:
    return gated(_col(c), adapters.to_markdown_source, lambda x: x.rlike("[$*]"))


def ce_to_latex(c) -> Column:
    """Chemical formulas and quantities of a math source by plain commands."""
    return gated(_col(c), adapters.ce_in_text, lambda x: x.rlike(r"\\(?:ce|pu)"))


def has_raw_math(c) -> Column:
    return F.coalesce(_col(c).rlike(adapters.RAW_MATH), F.lit(False))


def math_mask(c) -> Column:
    """For each code point whether it lies in a math segment."""
    return kernel(_mask, "array<boolean>")(_col(c))


def _mask(text):
    return None if text is None else tokens.mask(text)[:-1]


# --- keys and values of documents -----------------------------------------------------------------------------------


def is_url_or_path(c) -> Column:
    c = _col(c)
    out = F.lit(False)
    for p in URL_PREFIXES:
        out = out | c.startswith(p)
    low = F.lower(c)
    for e in FILE_EXTENSIONS:
        out = out | low.endswith(e)
    return F.coalesce(out, F.lit(False))


def is_non_content_key(c) -> Column:
    k = F.translate(F.lower(_col(c)), "-", "_")
    out = k.isin(sorted(NON_CONTENT_KEYS)) | F.regexp_replace(k, "_", "").isin(sorted(NON_CONTENT_KEYS))
    for s in NON_CONTENT_SUFFIXES:
        out = out | k.endswith(s)
    return F.coalesce(out, F.lit(False))


def is_not_rendered_key(c) -> Column:
    k = F.lower(_col(c))
    return F.coalesce(k.isin(sorted(NOT_RENDERED_KEYS)) | k.endswith("_raw") | k.startswith("raw_"), F.lit(False))


def has_block(c, *blocks: str) -> Column:
    """Whether the first line of one of the blocks is in the text."""
    out = F.lit(False)
    for b in blocks:
        out = out | _col(c).contains(b.split("\n", 1)[0])
    return out


def inject_block(c, block: str) -> Column:
    """The block before the text, unless its first line is in the text already."""
    c = _col(c)
    return F.when(has_block(c, block), c).otherwise(F.concat(F.lit(block + "\n\n"), c))


#: First lines of the blocks that the named injectors write, unless a caller gives blocks of its own.
LATEX_RULES = "=== FORMATTING RULES: FORMULAS ===\nWrite every formula as LaTeX between dollars, and an amount of dollars with an escaped one."
NARRATIVE_RULES = "=== FORMATTING RULES: READ ALOUD ===\nWrite plain prose that can be read aloud, with formulas in words and without any markup."
PLAIN_RULES = "=== FORMATTING RULES: PLAIN NOTATION ===\nWrite formulas in plain Unicode characters, without dollars, commands or markup."


def inject_latex_rules(c, block: str = LATEX_RULES) -> Column:
    """Rules for text that is typeset, before a prompt; once only."""
    return inject_block(c, block)


def inject_narrative_prose_rules(c, block: str = NARRATIVE_RULES) -> Column:
    """Rules for text that is spoken, before a prompt; once only."""
    return inject_block(c, block)


def inject_plain_notation_rules(c, block: str = PLAIN_RULES) -> Column:
    """Rules for text that is shown without typesetting, before a prompt; once only."""
    return inject_block(c, block)


def has_formatting_contract(c, *blocks: str) -> Column:
    """Whether a prompt holds one of the three blocks, or of those that are given instead."""
    return has_block(c, *(blocks or (LATEX_RULES, NARRATIVE_RULES, PLAIN_RULES)))


def narrative_field_exemption(*fields: str) -> str:
    """A clause that exempts the named fields of a model's answer from formatting rules."""
    return "These fields are read aloud and hold plain prose without markup: " + ", ".join(fields) + "." if fields else ""
