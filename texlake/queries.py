"""Queries over the tables, and the same in SQL.

Template queries build a text of its own for each row of ``orders`` in Spark, run a function over it, and are compared
with the expected text built from the same columns by SQL. Example queries run a function over literal inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .examples import EXAMPLES
from .functions import text as tx
from .operators import deep, findings
from .plans.layout import spread
from .sources import model_json
from .tables import HOMOGLYPHS, NAMED_ENTITIES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- templates ----------------------------------------------------------------------------------------------------

#: name: (function, text, expected text); «q» is the order's key and «n» a number from 1 to 7.
TEMPLATES: dict[str, tuple[Callable[[Column], Column], str, str]] = {
    "repair_formfeed": (tx.repair, "\x0crac{«q»}{2}", "\\frac{«q»}{2}"),
    "repair_tab": (tx.repair, "«q» \times «n»\x00 and\tso", "«q» \\times «n» and\tso"),
    "repair_readpath": (lambda c: tx.repair(c, False), "\x08eta\text{«q»}\x0bec{F}\x0bxx", "\\beta\text{«q»}\\vec{F}xx"),
    "repair_ansi": (tx.repair, "\x1b[1mPart «n»:\x1b[0m «q»", "Part «n»: «q»"),
    "repair_span": (tx.repair, "$x \nightarrow «q»$", "$x \\rightarrow «q»$"),
    "normalize_delimiters": (tx.normalize_delimiters, "Area \\(«q»x\\) and \\[y^«n»\\]", "Area $«q»x$ and $$y^«n»$$"),
    "strip_orphans": (tx.strip_orphan_delimiters, "left \\( «q» \\] right \\\\[2pt]", "left  «q»  right \\\\[2pt]"),
    "normalize_currency": (tx.normalize, "costs $«q» and $x^2$", "costs \\$«q» and $x^2$"),
    "escape_currency": (tx.escape_currency, "$«q»-$«n»", "\\$«q»-\\$«n»"),
    "normalize_padded": (tx.normalize, "Solve $ x + «q» = 0 $ for x.", "Solve $x + «q» = 0$ for x."),
    "trim_padded": (tx.trim_padded_spans, "I paid $ «q» and got $ 3; $ y^«n» $", "I paid $ «q» and got $ 3; $y^«n»$"),
    "normalize_escapes": (tx.normalize, "One «q».\\nTwo $\\nu$ \\neq «n»", "One «q».\nTwo $\\nu$ \\neq «n»"),
    "decode_escapes": (tx.decode_escapes_outside_math, "a\\tb «q» \\theta \\read: x", "a\tb «q» \\theta \\read: x"),
    "code_spans": (lambda c: tx.normalize(c, True), "`x^«q»` and `print(«n»)`", "$x^«q»$ and `print(«n»)`"),
    "mojibake_table": (tx.fix_mojibake, "Value of Ï€ is «q» â‰¤ Î±", "Value of π is «q» ≤ α"),
    "mojibake_currency": (tx.fix_mojibake, "â‚¬«q» or Â£«n»", "€«q» or £«n»"),
    "unescape_html": (tx.unescape_html, "«q»&thinsp;m &ampx &#x3C0;", "«q»\u2009m &x π"),
    "homoglyph_translate": (tx.normalize_homoglyphs, "−«q» µm ∆x K", "-«q» μm Δx K"),
    "canonicalize_symbols": (tx.canonicalize, "«q»×«n» and α", "$«q»\\times«n»$ and $\\alpha$"),
    "canonicalize_braces": (tx.canonicalize, "$x^1«q» + y_{«n»$", "$x^{1«q»} + y_{«n»}$"),
    "canonicalize_scripts": (tx.canonicalize, "x_«n» but lo_«q»", "$x_«n»$ but lo_«q»"),
    "canonicalize_urls": (tx.canonicalize, "see https://a.example/p_«q».png and E_n", "see https://a.example/p_«q».png and $E_n$"),
    "fix_scientific": (tx.fix, "«q»×10⁸", "$«q»\\times10^{8}$"),
    "fix_chemistry": (tx.fix, "«q» g of H₂SO₄", "«q» g of $\\text{H}_{2}\\text{SO}_{4}$"),
    "fix_greek_word": (tx.fix, "2πr and «q»λ", "$2\\pi r$ and $«q»\\lambda$"),
    "fix_merge": (tx.fix, "$\\times$ $10^«n»$ x «q»", "$\\times 10^«n»$ x «q»"),
    "fix_no_chemistry": (lambda c: tx.fix(c, False), "\\ce{H2O} «q»", "\\ce{H2O} «q»"),
    "merge_adjacent": (lambda c: tx.step("merge_adjacent_math", c), "$a$ $b_«n»$ and $$c$$ «q»", "$a b_«n»$ and $$c$$ «q»"),
    "close_braces": (lambda c: tx.step("close_unbalanced_braces", c), "$\\sqrt{x+«q»$ end", "$\\sqrt{x+«q»}$ end"),
    "option_text": (tx.normalize_option_text, "$\\text{Coulomb «q»}$", "Coulomb «q»"),
    "to_plain_text": (tx.to_plain, "$\\frac{«q»}{«n»}$ and $x^{2}$", "«q»/«n» and x²"),
    "to_plain_pdf": (lambda c: tx.to_plain(c, "pdf"), "$\\vec{F} = «q»\\hat{i}$", "F⃗ = «q»î"),
    "to_plain_tts": (lambda c: tx.to_plain(c, "tts"), "half is $\\frac{«q»}{«n»}$", "half is «q» over «n»"),
    "to_plain_compare": (tx.compare_key, "A) $\\frac{«q»}{«n»}$ × x²", "«q»/«n»*x^2"),
    "bracket_delimiters": (tx.to_bracket_delimiters, "costs \\$«q», $x^«n»$ and $$y$$", "costs $«q», \\(x^«n»\\) and \\[y\\]"),
    "escape_json": (tx.escape_latex_for_json, '{"a": "\\frac{«q»}{2}\\n$\\nu$"}', '{"a": "\\\\frac{«q»}{2}\\n$\\\\nu$"}'),
}

#: A text for each single step, and what the step makes of it.
STEP_TEMPLATES = {
    "unwrap_typographic_spans": ("«q» $\\ldots$ end", "«q» … end"),
    "wrap_bare_symbol_commands": ("«q» \\alpha and \\times here", "«q» $\\alpha$ and $\\times$ here"),
    "wrap_unicode_chemistry": ("«q» g of CO₂", "«q» g of $\\text{CO}_{2}$"),
    "wrap_unicode_scripts": ("x«n»² + «q»", "$x«n»^{2}$ + «q»"),
    "escape_text_specials": ("$\\text{«q»% of}$", "$\\text{«q»\\% of}$"),
    "unicode_math_to_latex": ("$«q» ≤ α$ ≤", "$«q» \\leq \\alpha$ ≤"),
    "convert_combining_vec": ("$F⃗ = «q»$", "$\\vec{F} = «q»$"),
    "wrap_bare_unicode_math": ("angle θ is «q»", "angle $\\theta$ is «q»"),
    "unescape_math_opener": ("\\$«q» \\times 2$", "$«q» \\times 2$"),
    "collapse_double_backslashes": ("$\\\\alpha$ «q» \\\\zzz", "$\\alpha$ «q» \\\\zzz"),
    "fix_command_typos": ("\\fre{«q»}{2} \\\\frc{3}", "\\frac{«q»}{2} \\\\frc{3}"),
    "fix_left_right_braces": ("$\\left{«q»\\right}$", "$\\left\\{«q»\\right\\}$"),
    "open_surplus_braces": ("$«q»}$", "${«q»}$"),
    "collapse_double_groups": ("$x^{{«q»}}$", "$x^{«q»}$"),
    "replace_angstrom": ("«q» \\AA and $d = «q» \\AA$", "«q» Å and $d = «q» \\text{Å}$"),
    "drop_orphan_dollar": ("area «q»cm$ is big", "area «q»cm is big"),
    "normalize_braces": ("$x^1«q»$ x^1«q»", "$x^{1«q»}$ x^1«q»"),
    "wrap_bare_latex_commands": ("so \\frac{«q»}{2} and", "so $\\frac{«q»}{2}$ and"),
    "wrap_bare_scripts": ("v_«n» and my_var_«q»", "$v_«n»$ and my_var_«q»"),
    "wrap_pure_math_short_strings": ("\\alpha + «q»", "$\\alpha + «q»$"),
    "bare_chemistry_to_unicode": ("H_2O «q»", "H₂O «q»"),
}
TEMPLATES |= {f"step_{name}": (partial(tx.step, name), text, expected) for name, (text, expected) in STEP_TEMPLATES.items()}


def _parts(template: str) -> list[tuple[bool, str]]:
    out = []
    for k, part in enumerate(template.replace("»", "«").split("«")):
        if part or k % 2:
            out.append((k % 2 == 1, part))
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, line = table(spark, sf_dir, "orders"), (F.col("o_orderkey") % 7 + 1).cast("int")
    rows = rows.select("o_orderkey", "o_custkey", line.alias("line"), F.col("o_orderkey").cast("string").alias("q"), line.cast("string").alias("n"))
    return spread(rows)


def template_column(template: str) -> Column:
    return F.concat(*[F.col(part) if named else F.lit(part) for named, part in _parts(template)])


def _literal(text: str) -> str:
    """A SQL string; control characters by their numbers."""
    out, plain = [], ""
    for c in text:
        if c < " " or c == "\x7f":
            out += ["'" + plain.replace("'", "''") + "'"] if plain else []
            out.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    out += ["'" + plain.replace("'", "''") + "'"] if plain or not out else []
    return " || ".join(out)


_NAMED = {"q": "cast(o_orderkey as varchar)", "n": "cast(line as varchar)"}
_ROWS = "(select o_orderkey, o_custkey, (o_orderkey % 7 + 1)::int as line from orders) as r"


def template_sql(template: str) -> str:
    return " || ".join(_NAMED[part] if named else _literal(part) for named, part in _parts(template))


def _template(name: str) -> Query:
    function, text, _ = TEMPLATES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _lines(spark, sf_dir).withColumn("text", template_column(text))
        return rows.select("o_orderkey", function(F.col("text")).alias("result"))

    return query


# --- examples -----------------------------------------------------------------------------------------------------

_EXAMPLE_FUNCTIONS = {
    "canonicalize": tx.canonicalize, "fix": tx.fix, "normalize": tx.normalize, "normalize_option_text": tx.normalize_option_text, "escape_latex_for_json": tx.escape_latex_for_json,
    "ce_to_latex": tx.ce_to_latex, "to_markdown_source": tx.to_markdown_source, "mask_escaped_dollars": tx.mask_escaped_dollars,
    **{f"to_plain_{s}": (lambda c, s=s: tx.to_plain(c, s)) for s in ("text", "pdf", "tts", "compare")},
}


def _example(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [F.struct(F.lit(k).alias("id"), F.lit(given).alias("text")) for k, (given, _) in enumerate(EXAMPLES[name])]
        table = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return table.select("id", _EXAMPLE_FUNCTIONS[name](F.col("text")).alias("result"))

    return query


def _example_sql(name: str) -> str:
    return "select * from (values " + ", ".join(f"({k}, {_literal(result)})" for k, (_, result) in enumerate(EXAMPLES[name])) + ") as t(id, result)"


# --- findings -------------------------------------------------------------------------------------------------------

#: A defect for each line number, and its kinds.
DEFECTS = {
    1: ("\\(«q»x\\)", ("legacy_delimiter", "legacy_delimiter")),
    2: ("only $«q»", ("unbalanced_dollar",)),
    3: ("\x0crac{«q»}{2}", ("control_char",)),
    4: ("H₂O «q»", ("unicode_chemistry",)),
    5: ("«q» × 2 \ufffd", ("bare_unicode_math", "mojibake")),
    6: ("$\\left{«q»$ $x^10 \\foo$", ("bare_left_brace", "script_missing_braces", "unsupported_command")),
    7: ("rac{«q»}{2} \\frac{1} $x \\sqrt$ \\\\alpha", ("lost_escape", "frac_missing_args", "command_missing_argument", "double_escaped_command")),
}


def _defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(None).cast("string")
    for line, (template, _) in DEFECTS.items():
        text = F.when(F.col("line") == line, template_column(template)).otherwise(text)
    return _lines(spark, sf_dir).withColumn("text", text).withColumn("parity", F.col("o_orderkey") % 2)


_KIND_ROWS = "(values " + ", ".join(f"({line}, '{kind}')" for line, (_, kinds) in DEFECTS.items() for kind in kinds) + ") as k(line, kind)"


def audit_kinds_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.count_by_kind(findings.audit_table(_defective(spark, sf_dir), "text"))


def audit_by_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.count_by_kind(findings.audit_table(_defective(spark, sf_dir), "text", keep=("parity",)), "parity")


def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.audit_table(_defective(spark, sf_dir), "text", keep=("parity",))
    return rows.rollup("parity", "kind").agg(F.count("*").alias("n"))


def audit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _defective(spark, sf_dir).select("line", tx.is_error(tx.audit_kinds("text")).alias("error"))
    return rows.groupBy("line", "error").agg(F.count("*").alias("n"))


def audit_unbalanced_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tx.audit_kinds(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(kinds, "unbalanced_dollar").alias("unbalanced"))


# --- tokenizer ----------------------------------------------------------------------------------------------------

SEGMENTED = "It is $x^«q»$ or $$y$$ for \\$«n»."


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", template_column(SEGMENTED))
    return rows.select("o_orderkey", F.posexplode(tx.segment("text")).alias("idx", "s")).select("o_orderkey", "idx", "s.*")


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir)


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).groupBy("kind", "display").agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("chars"))


def segment_offsets_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each segment starts, as a running sum of lengths before it."""
    key = F.col("o_orderkey").cast("string")
    rows = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.concat(F.lit("It is $x^{"), key, F.lit("}$ or $$y$$.")).alias("text"))
    before = Window.partitionBy("o_orderkey").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = findings.segments_table(rows, "text", "o_orderkey")
    return rows.select("o_orderkey", "idx", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("long").alias("start"))


def math_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", template_column(SEGMENTED))
    return rows.select("o_orderkey", F.explode(tx.math_ranges("text")).alias("r")).select("o_orderkey", "r.*")


_SEGMENTS_SQL = f"""
select o_orderkey, s.idx, s.kind, s.display, s.value, s.raw from {_ROWS}, lateral (values
  (0, 'text', false, 'It is ', 'It is '),
  (1, 'math', false, 'x^' || {_NAMED["q"]}, '$x^' || {_NAMED["q"]} || '$'),
  (2, 'text', false, ' or ', ' or '),
  (3, 'math', true, 'y', '$$y$$'),
  (4, 'text', false, ' for $' || {_NAMED["n"]} || '.', ' for \\$' || {_NAMED["n"]} || '.')
) as s(idx, kind, display, value, raw)
"""


def is_plain_prose_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_plain_prose("text").alias("plain"))


def contains_math_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.contains_math("text").alias("math"))


#: A text for each number of a line, and what ``fix`` makes of it: plain prose, amounts and formulas side by side.
MIXED = {
    1: ("mass of «q»×10⁸ kg", "mass of $«q»\\times10^{8}$ kg"), 2: ("plain prose «q», nothing else.", "plain prose «q», nothing else."), 3: ("\x0crac{«q»}{2} of H₂O", "$\\frac{«q»}{2}$ of $\\text{H}_{2}\\text{O}$"),
    4: ("costs $«q» today", "costs \\$«q» today"), 5: ("see https://a.example/x_«q»", "see https://a.example/x_«q»"), 6: ("\\(x_1«q»\\) holds", "$x_{1«q»}$ holds"), 7: ("$\\sqrt{«q»$ is closed", "$\\sqrt{«q»}$ is closed"),
}


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(None).cast("string")
    for line, (template, _) in MIXED.items():
        text = F.when(F.col("line") == line, template_column(template)).otherwise(text)
    return _lines(spark, sf_dir).withColumn("text", text)


def fix_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("o_orderkey", tx.fix("text").alias("result"))


def contains_math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed(spark, sf_dir).withColumn("text", F.when(F.col("line") == 1, template_column("$x_«q»$")).when(F.col("line") == 3, template_column("$$«q»$$")).otherwise(F.col("text")))
    return rows.select("o_orderkey", tx.contains_math("text").alias("math"))


#: Where each kind of defect stands: a fixed number of characters, and whether the key stands before it too.
_PLACES = "(values " + ", ".join(
    f"({line}, '{kind}', {fixed}, {more})"
    for line, kind, fixed, more in (
        (1, "legacy_delimiter", 0, 0), (1, "legacy_delimiter", 3, 1), (2, "unbalanced_dollar", 5, 0), (3, "control_char", 0, 0), (4, "unicode_chemistry", 0, 0), (5, "bare_unicode_math", 1, 1), (5, "mojibake", 5, 1),
        (6, "bare_left_brace", 1, 0), (6, "script_missing_braces", 11, 1), (6, "unsupported_command", 15, 1), (7, "lost_escape", 0, 0), (7, "frac_missing_args", 9, 1), (7, "command_missing_argument", 21, 1), (7, "double_escaped_command", 28, 1),
    )
) + ") as k(line, kind, fixed, more)"


def audit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.audit_table(_defective(spark, sf_dir), "text", keep=("o_orderkey",)).select("o_orderkey", "kind", "position")


def audit_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.audit_table(_defective(spark, sf_dir).where("line in (2, 3, 4)"), "text", keep=("o_orderkey",)).select("o_orderkey", "snippet")


def _by_line(spark: SparkSession, sf_dir: str, texts: dict[int, str]) -> DataFrame:
    text = template_column(texts[0])
    for line, template in texts.items():
        text = F.when(F.col("line") == line, template_column(template)).otherwise(text)
    return _lines(spark, sf_dir).withColumn("text", text)


def is_formula_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_line(spark, sf_dir, {0: "«q»", 1: "«q»x + 3", 2: "«q» apples", 5: "\\alpha + «q»"})
    return rows.select("o_orderkey", tx.is_formula("text").alias("formula"))


def currency_positions_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("at", tx.currency_positions(template_column("$«q» or $3 and $x^2$")))
    return rows.select("o_orderkey", F.col("at")[0].alias("first"), F.col("at")[1].alias("second"), F.size("at").alias("n"))


def math_mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("mask", tx.math_mask(template_column("a$«q»$ b")))
    return rows.select("o_orderkey", F.size(F.filter("mask", lambda x: x)).alias("n_math"), F.size("mask").alias("n_all"))


def has_raw_math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_line(spark, sf_dir, {0: "a «q» $x$", 1: "$\\frac{«q»}{2}$", 2: "\\(«q»", 3: "\\[«q»"})
    return rows.select("o_orderkey", tx.has_raw_math("text").alias("raw"))


def not_rendered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["raw_text", "Prompt", "a_raw", "RAW_x", "body", "rawtext"]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name")).select("name", tx.is_not_rendered_key("name").alias("flag"))


def repair_deep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct(template_column("\x0crac{«q»}{2}").alias("user_id"), F.array(template_column("\x08eta «q»")).alias("items"))
    rows = _lines(spark, sf_dir).select("o_orderkey", body.alias("body"), F.create_map(F.lit("hint"), template_column("\x0bec «q»")).alias("notes"))
    return deep.repair_deep(rows, ["body", "notes"]).select("o_orderkey", "body.user_id", F.col("body.items")[0].alias("item"), F.col("notes")["hint"].alias("hint"))


def canonicalize_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("doc", template_column('{"a": "«q»≤5", "id": "x≤5"}'))
    return rows.select("o_orderkey", deep.canonicalize_json("doc").alias("doc"))


def audit_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("o_orderkey", F.explode(deep.audit_json(template_column('[{"a": "H₂O «q»", "id": "H₂O"}]'))).alias("f"))
    return rows.select("o_orderkey", "f.path", "f.kind", "f.position")


def named_injectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    injected = F.col("text")
    for inject in (tx.inject_latex_rules, tx.inject_narrative_prose_rules, tx.inject_plain_notation_rules):
        injected = inject(inject(injected))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.length(injected).alias("chars"), tx.has_formatting_contract(injected).alias("has"), tx.has_formatting_contract("text").alias("had"))


def needs_fix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") == 1, template_column("«q»×10⁸")).otherwise(template_column("costs $«q»")))
    return rows.groupBy("line").agg(F.sum(tx.needs_fix("text").cast("int")).alias("n_needs_fix"), F.count("*").alias("n"))


# --- money, answers, documents --------------------------------------------------------------------------------------


def currency_spans_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", template_column("paid $«q».50, ₹ «n»"))
    return findings.amounts(rows, "text", keep=("o_orderkey",)).withColumn("amount", F.col("amount").cast("double"))


def currency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", template_column("paid $«q».50 for $x^2$"))
    return findings.amounts(rows, "text", keep=("o_custkey",)).groupBy("o_custkey").agg(F.sum("amount").cast("double").alias("total"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    key = F.col("o_orderkey").cast("string")
    left = orders.select("o_orderkey", F.concat(F.lit("$\\frac{"), key, F.lit("}{3}$")).alias("given"))
    right = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("expected_key"), F.concat(key, F.lit(" / 3")).alias("expected"))
    return left, right


def answers_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _answers(spark, sf_dir)
    return findings.match_answers(left, right, "given", "expected").select("o_orderkey", "expected_key", "answer_key")


def answers_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _answers(spark, sf_dir)
    return findings.match_answers(left, right, "given", "expected", how="left_semi").select("o_orderkey")


def answers_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _answers(spark, sf_dir)
    return findings.match_answers(left, right, "given", "expected", how="left_anti").select("o_orderkey")


def answers_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_name")
    return findings.distinct_answers(parts, "p_name")


def json_transport_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", template_column('{"q": "\\frac{«q»}{2}, $\\nu$\\nend", "n": «n»}'))
    doc = model_json.loads_latex_aware("text", "q string, n int")
    return rows.select("o_orderkey", doc.alias("d")).select("o_orderkey", "d.q", "d.n")


def json_transport_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("text", template_column('{"q": "A «q».\\nB.", "n": «n»}'))
    doc = model_json.loads_model_json("text", "q string, n int", lenient=False)
    return rows.select("o_orderkey", doc.alias("d")).select("o_orderkey", "d.q", "d.n")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    body = F.struct(F.concat(key, F.lit("×10⁸")).alias("text"), F.concat(key, F.lit("×2")).alias("user_id"), F.array(F.lit("H₂O"), F.concat(F.lit("x₁ "), key)).alias("items"))
    notes = F.create_map(F.lit("hint"), F.lit("mc²"), F.lit("imageUrl"), F.lit("mc²"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", body.alias("body"), notes.alias("notes"), F.lit("x₁").alias("narration"))


def fix_deep_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deep.fix_deep(_documents(spark, sf_dir), ["body", "narration"], narrative_keys=("narration@body",))
    return rows.select("o_orderkey", "body.text", "body.user_id", F.col("body.items")[0].alias("item0"), F.col("body.items")[1].alias("item1"), "narration")


def fix_deep_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deep.fix_deep(_documents(spark, sf_dir), ["notes"])
    return rows.select("o_orderkey", F.col("notes")["hint"].alias("hint"), F.col("notes")["imageUrl"].alias("image_url"))


def fix_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.concat(F.lit('{"a": ["H₂O"], "id": "x₁", "n": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("doc"))
    return rows.select("o_orderkey", deep.fix_json("doc").alias("doc"))


def canonicalize_deep_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.lit("2026-09-25 10:00:00").cast("timestamp").alias("made"), F.lit("x≤5").alias("body"))
    return deep.canonicalize_deep(rows, ["made", "body"])


def audit_deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deep.audit_deep(_documents(spark, sf_dir), ["body", "notes"])
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"))


def entities_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.fix_mojibake("html")).alias("digest"))


def _entities_sql() -> str:
    out = "html"
    for _ in range(3):
        for name, sign in sorted(NAMED_ENTITIES.items(), key=lambda x: x[0] == "&amp;"):
            out = f"replace({out}, {_literal(name)}, {_literal(sign)})"
    return f"select page_id, md5(regexp_replace(replace({out}, chr(160), ' '), '[\\x{{80}}-\\x{{9f}}]', '', 'g')) as digest from pages"


BLOCK = "## Formatting rules\nWrite every formula between dollars."


def inject_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = tx.inject_block(F.col("text"), BLOCK)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", once.alias("text"))
    return rows.select("conv_id", "turn", F.length(tx.inject_block(F.col("text"), BLOCK)).alias("chars"), tx.has_block("text", BLOCK).alias("has"))


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["user_id", "userId", "title", "grade-level", "imageUrl", "body"]
    values = ["https://a.example/x", "plain", "/api/x", "a.PNG", "gs://b/c"]
    keys = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name")).select("name", tx.is_non_content_key("name").alias("flag"))
    return keys.union(spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("name")).select("name", tx.is_url_or_path("name").alias("flag")))


def homoglyph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_homoglyphs("text")).alias("digest"))


def fix_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.fix("text").alias("text"))


_PLAIN = [
    audit_kinds_count, audit_by_parity, audit_rollup, audit_errors, audit_unbalanced_docs, segment_rows, segment_counts, segment_offsets_window, math_ranges,
    is_plain_prose_docs, contains_math_docs, needs_fix_share, currency_spans_rows, currency_totals, answers_match_join, answers_semi, answers_anti,
    answers_dedup, json_transport_decode, json_transport_strict, fix_deep_struct, fix_deep_map, fix_json_documents, canonicalize_deep_dates, audit_deep_paths,
    entities_pages, inject_block, document_keys, homoglyph_docs, fix_docs, fix_mixed, contains_math_lines, audit_positions, audit_snippets, is_formula_rows,
    currency_positions_rows, math_mask_rows, has_raw_math_rows, not_rendered_keys, repair_deep_rows, canonicalize_json_rows, audit_json_rows, named_injectors,
]


def queries() -> dict[str, Query]:
    out = {q.__name__: q for q in _PLAIN}
    out |= {name: _template(name) for name in TEMPLATES}
    return out | {f"examples_{name}": _example(name) for name in EXAMPLES}


def oracle_sql() -> dict[str, str]:
    q, n = _NAMED["q"], _NAMED["n"]
    kinds = f"{_ROWS} join {_KIND_ROWS} on r.line = k.line"
    out = {name: f"select o_orderkey, {template_sql(expected)} as result from {_ROWS}" for name, (_, _, expected) in TEMPLATES.items()}
    out |= {f"examples_{name}": _example_sql(name) for name in EXAMPLES}
    third = "o_orderkey % 3 = 0"
    position = f"select o_orderkey, kind, (fixed + more * length({q}))::int as position from {_ROWS} join {_PLACES} on r.line = k.line"
    mixed = " ".join(f"when {line} then {template_sql(expected)}" for line, (_, expected) in MIXED.items())
    return out | {
        "audit_kinds_count": f"select kind, count(*) as n from {kinds} group by kind",
        "audit_by_parity": f"select o_orderkey % 2 as parity, kind, count(*) as n from {kinds} group by all",
        "audit_rollup": f"select parity, kind, count(*) as n from (select o_orderkey % 2 as parity, kind from {kinds}) group by rollup (parity, kind)",
        "audit_errors": f"select line, line = 3 as error, count(*) as n from {_ROWS} group by all",
        "audit_unbalanced_docs": "select doc_id, (length(text) - length(replace(text, '$', ''))) % 2 = 1 as unbalanced from documents",
        "segment_rows": _SEGMENTS_SQL,
        "segment_counts": f"select kind, display, count(*) as n, sum(length(raw))::bigint as chars from ({_SEGMENTS_SQL}) group by all",
        "segment_offsets_window": "select o_orderkey, t.idx, (t.fixed + t.more * length(o_orderkey::varchar))::bigint as start from orders, (values (0, 0, 0), (1, 6, 0), (2, 12, 1), (3, 16, 1), (4, 21, 1)) as t(idx, fixed, more)",
        "math_ranges": f'select o_orderkey, 6 as start, 10 + length({q}) as "end", false as display from {_ROWS} union all select o_orderkey, 14 + length({q}), 19 + length({q}), true from {_ROWS}',
        "is_plain_prose_docs": r"""select doc_id, not (length(translate(text, '\$*~`|[]<>#⸻【' || chr(13), '')) < length(text) or contains(text, chr(10) || chr(10)) or contains(text, '--')
            or contains(text, '(x) ') or contains(text, '(X) ') or contains(text, '( ) ') or len(list_filter(string_split(text, chr(10)), lambda x: x <> ltrim(x, ' ' || chr(9)) and trim(x) <> ''
            or x[1:2] in ('- ', '* ', '+ ') or regexp_matches(x, '^[0-9]+[.)] '))) > 0) as plain from documents""",
        "contains_math_docs": r"""select doc_id, regexp_matches(text, '\\[A-Za-z]') or regexp_matches(text, '(?s)\\\(.*\\\)|\\\[.*\\\]') or regexp_matches(text, '(?s)\$\$.+\$\$') or regexp_matches(text, '\$[^\s$]([^\n$]*[^\s$])?\$([^0-9]|$)') as math from documents""",
        "contains_math_lines": f"select o_orderkey, line in (1, 3, 6, 7) as math from {_ROWS}",
        "audit_positions": position,
        "audit_snippets": f"select o_orderkey, case line when 2 then 'only $' || {q} when 3 then '<0x0c>rac{{' || {q} || '}}{{2}}' else 'H₂O ' || {q} end as snippet from {_ROWS} where line in (2, 3, 4)",
        "is_formula_rows": f"select o_orderkey, line in (1, 5) as formula from {_ROWS}",
        "currency_positions_rows": f"select o_orderkey, 0 as first, 5 + length({q}) as second, 2::int as n from {_ROWS}",
        "math_mask_rows": f"select o_orderkey, 2 + length({q}) as n_math, 5 + length({q}) as n_all from {_ROWS}",
        "has_raw_math_rows": f"select o_orderkey, line <= 3 as raw from {_ROWS}",
        "not_rendered_keys": "select * from (values ('raw_text', true), ('Prompt', true), ('a_raw', true), ('RAW_x', true), ('body', false), ('rawtext', false)) as t(name, flag)",
        "repair_deep_rows": f"select o_orderkey, '\\frac{{' || {q} || '}}{{2}}' as user_id, '\\beta ' || {q} as item, '\\vec ' || {q} as hint from {_ROWS}",
        "canonicalize_json_rows": f"""select o_orderkey, '{{"a": "$' || {q} || '\\\\leq5$", "id": "x≤5"}}' as doc from {_ROWS}""",
        "audit_json_rows": f"select o_orderkey, '[0].a' as path, 'unicode_chemistry' as kind, 0 as position from {_ROWS}",
        "fix_mixed": f"select o_orderkey, case line {mixed} end as result from {_ROWS}",
        "named_injectors": f"select conv_id, turn, (length(text) + 6 + {sum(len(b) for b in (tx.LATEX_RULES, tx.NARRATIVE_RULES, tx.PLAIN_RULES))})::int as chars, true as has, false as had from conversations",
        "needs_fix_share": f"select line, sum((line = 1)::int)::bigint as n_needs_fix, count(*) as n from {_ROWS} group by 1",
        "currency_spans_rows": f"""select o_orderkey, 5 as start, 9 + length({q}) as "end", '$' || {q} || '.50' as text, (o_orderkey + 0.5)::double as amount from {_ROWS}
            union all select o_orderkey, 11 + length({q}), 13 + length({q}) + length({n}), '₹ ' || {n}, line::double from {_ROWS}""",
        "currency_totals": f"select o_custkey, sum(o_orderkey + 0.5)::double as total from {_ROWS} group by 1",
        "answers_match_join": f"select o_orderkey, o_orderkey as expected_key, o_orderkey || '/3' as answer_key from orders where {third}",
        "answers_semi": f"select o_orderkey from orders where {third}",
        "answers_anti": f"select o_orderkey from orders where not ({third})",
        "answers_dedup": r"select regexp_replace(trim(regexp_replace(p_name, '\s+', ' ', 'g')), ' ?([-+*/=<>^_(),{}\[\]]) ?', '\1', 'g') as answer_key, count(*) as n from part group by 1",
        "json_transport_decode": f"select o_orderkey, '\\frac{{' || {q} || '}}{{2}}, $\\nu$' || chr(10) || 'end' as q, line::int as n from {_ROWS}",
        "json_transport_strict": f"select o_orderkey, 'A ' || {q} || '.' || chr(10) || 'B.' as q, line::int as n from {_ROWS}",
        "fix_deep_struct": r"select o_orderkey, '$' || o_orderkey || '\times10^{8}$' as text, o_orderkey || '×2' as user_id, '$\text{H}_{2}\text{O}$' as item0, '$x_{1}$ ' || o_orderkey as item1, 'x₁' as narration from orders",
        "fix_deep_map": "select o_orderkey, '$mc^{2}$' as hint, 'mc²' as image_url from orders",
        "fix_json_documents": r"""select o_orderkey, '{"a": ["$\\text{H}_{2}\\text{O}$"], "id": "x₁", "n": ' || o_orderkey || '}' as doc from orders""",
        "canonicalize_deep_dates": r"select o_orderkey, '2026-09-25T10:00:00+00:00' as made, '$x\leq5$' as body from orders",
        "audit_deep_paths": "select path, kind, count(*) as n from orders, (values ('body.text', 'bare_unicode_math'), ('body.items[0]', 'unicode_chemistry')) as t(path, kind) group by all",
        "entities_pages": _entities_sql(),
        "inject_block": f"select conv_id, turn, (length(text) + {len(BLOCK) + 2})::int as chars, true as has from conversations",
        "document_keys": "select * from (values ('user_id', true), ('userId', true), ('title', false), ('grade-level', true), ('imageUrl', true), ('body', false), ('https://a.example/x', true), ('plain', false), ('/api/x', true), ('a.PNG', true), ('gs://b/c', true)) as t(name, flag)",
        "homoglyph_docs": "select doc_id, md5(translate(text, " + _literal("".join(HOMOGLYPHS)) + ", " + _literal("".join(HOMOGLYPHS.values())) + ")) as digest from documents",
    }
