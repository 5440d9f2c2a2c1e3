"""The text functions: examples, invariants, native forms against kernels, documents, sources and streams."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from texlake import queries, sql
from texlake.examples import EXAMPLES
from texlake.functions import text as tx
from texlake.kernels import adapters, display, encoding, findings, fixing, mend, options, plain, symbols, tokens, transport, walk, write
from texlake.operators import deep
from texlake.operators import findings as rows_of
from texlake.plans import gates, layout
from texlake.sources import model_json
from texlake.streaming import text_streams

KERNELS = {
    "canonicalize": write.canonicalize, "fix": fixing.fix, "normalize": display.normalize, "normalize_option_text": options.normalize_option_text,
    "escape_latex_for_json": transport.escape_latex_for_json, "ce_to_latex": adapters.ce_in_text, "to_markdown_source": adapters.to_markdown_source,
    "mask_escaped_dollars": adapters.mask_escaped_dollars, **{f"to_plain_{s}": (lambda t, s=s: plain.to_plain(t, s)) for s in plain.STYLES},
}
ALL_INPUTS = [given for pairs in EXAMPLES.values() for given, _ in pairs]
PIECES = [
    "$", "$$", "\\", "\\$", "{", "}", "^", "_", "x", "2", "12", " ", "\n", "\t", "\x0c", "frac", "\\frac{1}{2}", "\\alpha", "π", "²", "₂", "H₂O", "√", "×", "≤", "\\(", "\\)", "\\[", "\\]", "Â£", "Ï", "&amp;",
    "word", "\\text{m}", "$5", "%", "`", "\\ne", "\\n", "é", " ", "°", "\\AA", "µ", "e^{iπ}", "https://a.example/b_c", "\\left{", "ightarrow", ":", "teacher", "⃗", "(x) ", "1.",
]


def fuzz(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", EXAMPLES)
def test_examples(name):
    for given, expected in EXAMPLES[name]:
        assert KERNELS[name](given) == expected, given


def test_rewrites_of_examples_are_stable():
    for name in ("canonicalize", "fix", "normalize", "normalize_option_text"):
        for given in ALL_INPUTS:
            once = KERNELS[name](given)
            assert KERNELS[name](once) == once, (name, given)


def test_segments_hold_the_whole_text():
    for text in [*ALL_INPUTS, *fuzz(1, 3000)]:
        assert "".join(s.raw for s in tokens.segment(text)) == text
        assert all(s.raw and (s.value or not s.math or s.raw[0] == "\\") for s in tokens.segment(text))


def test_repair_is_lossless_and_stable():
    for text in fuzz(2, 3000):
        once = mend.repair(text)
        assert mend.repair(once) == once
        keep = lambda t: "".join(c for c in t if c not in "\t\n\r\x0c\\")
        assert all(c in keep(once) for c in keep(text))


def test_normalize_is_stable_on_fuzz():
    bad = [t for t in fuzz(3, 3000) if display.normalize(display.normalize(t)) != display.normalize(t)]
    assert len(bad) < 60  # damaged texts of random pieces, not content


def test_fix_never_makes_display_math_of_prose():
    for text in ALL_INPUTS:
        if "$$" not in text:
            assert "$$" not in fixing.fix(text)


def test_audit_finds_nothing_that_fix_mends():
    for text in ALL_INPUTS:
        assert not set(findings.audit_kinds(fixing.fix(text))) & {"control_char", "legacy_delimiter", "bare_left_brace"}, text


def test_needs_fix_is_the_difference():
    for text in [*ALL_INPUTS, *fuzz(4, 500)]:
        assert fixing.needs_fix(text) == (fixing.fix(text) != display.normalize(text))


def test_null_and_empty():
    for f in (mend.repair, display.normalize, write.canonicalize, fixing.fix, plain.to_plain, encoding.fix_mojibake, options.normalize_option_text):
        assert f(None) is None and f("") == ""
    assert tokens.segment("") == [] == findings.audit("") and not tokens.contains_math(None)
    assert tokens.is_plain_prose("") and not tokens.is_plain_prose(None)
    with pytest.raises(ValueError, match="style"):
        plain.to_plain("x", "loud")


def test_long_and_deep_texts():
    deepest = "$" + "{" * 3000 + "x" + "}" * 3000 + "$"
    for text in (deepest, "\\frac{" * 900 + "}" * 900, "α " * 20_000, "$a{" * 3000, "\\$5 " * 8000, "a" * 100_000):
        for f in (fixing.fix, plain.to_plain, findings.audit, display.normalize):
            f(text)


def slow_closer(text, start, closer):
    depth, at = 0, start
    while at < len(text):
        if depth <= 0 and text.startswith(closer, at):
            return at
        depth += (text[at] == "{") - (text[at] == "}")
        at += 2 if text[at] == "\\" else 1
    return -1


def test_closers_against_a_scan_for_each_opener():
    closers = {"\\[": "\\]", "\\(": "\\)", "$": "$", "$$": "$$"}
    for text in [*ALL_INPUTS, *fuzz(31, 3000)]:
        at, signs = tokens.signs_of(text)
        for i, sign, k in zip(at, signs, tokens.partners(text, at, signs), strict=True):
            opener = "$$" if text.startswith("$$", i) and sign == "$" else sign
            if opener in closers:
                assert (at[k] if k >= 0 else -1) == slow_closer(text, i + len(opener), closers[opener]), (text, i)


def test_time_grows_with_length():
    def seconds(f, text):
        tokens.spans.cache_clear()
        began = time.perf_counter()
        f(text)
        return time.perf_counter() - began

    for unit in ("$a{", "\\(x ", "$$y{", "see https://a.example/b and ", "\\frac{1}{2} $x$ "):
        for f in (fixing.fix, write.canonicalize, findings.audit):
            long = seconds(f, unit * (40_000 // len(unit)))
            assert long < 2 and long < 40 * max(seconds(f, unit * (4_000 // len(unit))), 0.005), (unit, f.__name__, long)


def test_many_urls_come_back():
    text = " ".join(f"https://a.example/{k}/x_1 and {{{{IMAGE:{k}}}}}" for k in range(9000))
    assert write.canonicalize(text) == text


def test_signs_as_handlers():
    assert write.collapse_backslashes("\\\\alpha \\\\zzz $a \\\\beta & b$") == "\\alpha \\\\zzz $a \\\\beta & b$"
    assert write.dollar_delimiters("\\(a\\) \\[b\\] \\(\\) \\\\(c") == "$a$ $$b$$ \\(\\) \\\\(c"
    assert write.close_braces("$\\frac{1}{2$ and $\\frac{$ and $x$") == "$\\frac{1}{2}$ and $\\frac{$ and $x$"
    assert write.open_surplus_braces("$x}$ $a}{b$ $$c}}$$") == "${x}$ $a}{b$ $${{c}}$$"
    assert write.brace_scripts("$x^10$ y^10 $$a_12 + id_1_22$$ $z^34") == "$x^{10}$ y^10 $$a_{12} + id_1_22$$ $z^34"
    assert write.escape_lone_currency("$5, $x and $7,000.50.") == "\\$5, $x and \\$7,000.50."
    assert write.put_dollars_aside("\\$ \\\\$") == write.DOLLAR + " \\\\$"


def test_greek_words():
    clusters = symbols.Clusters("area 2πr and αβγ")
    assert clusters.word(6) == (5, 8) and clusters.word(14) is None


# --- columns -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate([*ALL_INPUTS, *fuzz(5, 1500), "", None, "plain words", "Zwölf Boxkämpfer"]))
    return spark.createDataFrame(rows, "id int, text string").cache()


def as_dict(df):
    return {r["id"]: r["r"] for r in df.collect()}


COLUMNS = {
    "repair": (tx.repair, mend.repair),
    "repair_read": (lambda c: tx.repair(c, False), lambda t: mend.repair(t, False)),
    "normalize": (tx.normalize, display.normalize),
    "normalize_code": (lambda c: tx.normalize(c, True), lambda t: display.normalize(t, True)),
    "canonicalize": (tx.canonicalize, write.canonicalize),
    "fix": (tx.fix, fixing.fix),
    "option": (tx.normalize_option_text, options.normalize_option_text),
    "mojibake": (tx.fix_mojibake, encoding.fix_mojibake),
    "html": (tx.unescape_html, encoding.unescape_html),
    "orphans": (tx.strip_orphan_delimiters, display.strip_orphans),
    "homoglyphs": (tx.normalize_homoglyphs, symbols.normalize_homoglyphs),
    "json": (tx.escape_latex_for_json, transport.escape_latex_for_json),
    "brackets": (tx.to_bracket_delimiters, adapters.to_bracket_delimiters),
    "markdown": (tx.to_markdown_source, adapters.to_markdown_source),
    "dollars": (tx.mask_escaped_dollars, adapters.mask_escaped_dollars),
    **{f"plain_{s}": ((lambda c, s=s: tx.to_plain(c, s)), (lambda t, s=s: plain.to_plain(t, s))) for s in plain.STYLES},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_equal_kernels(texts, name):
    """Also shows that each gate holds wherever its kernel changes a text."""
    column, f = COLUMNS[name]
    given, got = as_dict(texts.select("id", F.col("text").alias("r"))), as_dict(texts.select("id", column("text").alias("r")))
    assert got == {k: None if t is None else f(t) for k, t in given.items()}


def test_predicates_and_arrays_equal_kernels(texts):
    given = as_dict(texts.select("id", F.col("text").alias("r")))
    assert as_dict(texts.select("id", tx.is_plain_prose("text").alias("r"))) == {k: tokens.is_plain_prose(t) for k, t in given.items()}
    assert as_dict(texts.select("id", tx.contains_math("text").alias("r"))) == {k: tokens.contains_math(t) for k, t in given.items()}
    assert as_dict(texts.select("id", tx.needs_fix("text").alias("r"))) == {k: fixing.needs_fix(t) for k, t in given.items()}
    assert as_dict(texts.select("id", tx.audit_kinds("text").alias("r"))) == {k: findings.audit_kinds(t) for k, t in given.items()}
    rows = as_dict(texts.select("id", tx.segment("text").alias("r")))
    assert {k: [tuple(s) for s in v] for k, v in rows.items()} == {k: [tuple(s) for s in tokens.segment(t)] for k, t in given.items()}
    rows = as_dict(texts.select("id", tx.math_ranges("text").alias("r")))
    assert {k: [tuple(s) for s in v] for k, v in rows.items()} == {k: tokens.ranges(t or "") for k, t in given.items()}
    rows = as_dict(texts.select("id", tx.currency_spans("text").alias("r")))
    assert {k: [tuple(s) for s in v] for k, v in rows.items()} == {k: display.currency_spans(t) for k, t in given.items()}


def test_gates_keep_plain_text_in_the_jvm(spark):
    rows = spark.createDataFrame([("Plain words, numbers 12 and accents é.\nA second line.",)], "text string")
    for gate in (gates.repair, gates.normalize, gates.fix, gates.plain, gates.encoding, gates.audit, gates.segments):
        assert rows.where(gate(F.col("text"))).count() == 0


def test_patterns_survive_long_texts(spark):
    rows = spark.createDataFrame([("x" * 40_000 + " $" + "a " * 20_000,), ("\\" * 30_000,)], "text string")
    rows.select(tx.repair("text"), tx.repair("text", False), tx.is_plain_prose("text"), tx.normalize("text"), tx.audit_kinds("text")).collect()


def test_sql_names(spark):
    names = sql.register(spark)
    row = spark.sql(r"select tx_fix('H₂O') as a, tx_to_plain_compare(r'$\frac{1}{2}$') as b, size(tx_segment('a $x$')) as c, tx_fix(null) as d").first()
    assert tuple(row) == ("$\\text{H}_{2}\\text{O}$", "1/2", 2, None) and "tx_merge_adjacent_math" in names


def test_sql_names_equal_columns(spark):
    names = sql.register(spark)
    inputs = [*ALL_INPUTS, *fuzz(41, 300), None, "", "plain words", "A) 1 / 2"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(inputs)], "k int, t string").repartition(4).cache()
    forms = {"tx_segment": tx.segment, "tx_audit": tx.audit, "tx_contains_math": tx.contains_math, "tx_needs_fix": tx.needs_fix, "tx_fix": tx.fix, "tx_to_plain_compare": tx.compare_key}
    forms |= {"tx_to_plain_tts": lambda c: tx.to_plain(c, "tts"), "tx_repair_read": lambda c: tx.repair(c, False), "tx_is_plain_prose": tx.is_plain_prose, "tx_is_url_or_path": tx.is_url_or_path, "tx_currency_spans": tx.currency_spans}
    for name, f in forms.items():
        assert name in names and df.select(F.expr(f"{name}(t)").eqNullSafe(f(F.col("t"))).alias("same")).where("not same").count() == 0, name
    plan = spark.sql("select tx_fix(x) as y from (select cast(id as string) as x from range(3))")._jdf.queryExecution().toString()
    assert "CASE WHEN" in plan.split("ArrowEvalPython")[1]


def test_answers_without_notation_are_folded_in_the_jvm(spark):
    rng = random.Random(42)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 11))) for signs in ("abXH019  ..", "abXH019 +-/=*", "abXH019  (),<>", "aH1  .):/(", "ab01 \n,") for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.compare_key("t").alias("a"), tx.to_plain("t", "tts").alias("b")).collect()
    for r in rows:
        assert r["a"] == plain.to_plain(r["t"], "compare") and r["b"] == plain.to_plain(r["t"], "tts"), r["t"]


def test_audit_deep_by_the_schema_equals_the_walk(spark):
    doc = {
        "title": "x≤5", "user_id": "≤", "raw_text": "≤", "n": 3, "parts": [{"body": "H₂O", "url": "https://a.example/≤"}, {"body": None, "url": "α"}], "grid": [["≤", "ok"], [], None],
        "notes": {"hint": "y≤2", "imageUrl": "≤", "prompt": "≤"}, "inner": '{"c": ["H₂O"], "id": "≤"}', "broken": "{ x≤5", "none": None,
    }
    kind = "title string, user_id string, raw_text string, n int, parts array<struct<body: string, url: string>>, grid array<array<string>>, notes map<string, string>, inner string, broken string, none array<string>"
    df = spark.createDataFrame([doc], kind)
    found = [(r["path"], r["kind"], r["position"], r["snippet"]) for r in deep.audit_deep(df).collect()]
    assert sorted(found) == sorted((path, *f) for path, f in walk.audit_deep(doc)) and len(found) > 5
    assert deep.audit_deep(df, ["n", "user_id"]).count() == 0 and deep.audit_deep(df, ["title"], keep=("n",)).columns == ["n", "path", "kind", "position", "snippet"]


def test_maps_by_distinct_key(spark):
    kind = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    rows = [({"script": ["x₁"], "transcript": ["y₂"], "body": ["x₁", None]},), ({"script": ["x₁"], "imageUrl": ["x₁"]},), ({},), (None,), ({"a": None, "b": []},)]
    out = [r["m"] for r in deep.fix_deep(spark.createDataFrame(rows, kind).coalesce(1), narrative_keys=("script@transcript",)).collect()]
    assert out == [{"script": ["x₁"], "transcript": ["$y_{2}$"], "body": ["$x_{1}$", None]}, {"script": ["$x_{1}$"], "imageUrl": ["x₁"]}, {}, None, {"a": None, "b": []}]


def test_nested_rows_without_signs_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(["plain"], {"k": "words"}), (["x₁"], {"k": "plain"})], "a array<string>, m map<string, string>")
    plan = deep.fix_deep(df)._jdf.queryExecution().toString()
    assert plan.count("exists(") >= 2 and "CASE WHEN" in plan.split("ArrowEvalPython")[1]


def test_named_injectors(spark):
    row = spark.range(1).select(F.lit("Write.").alias("p"))
    for inject in (tx.inject_latex_rules, tx.inject_narrative_prose_rules, tx.inject_plain_notation_rules):
        once = row.select(inject("p").alias("p"))
        assert once.select(inject("p").alias("q")).first()["q"] == once.first()["p"] and once.select(tx.has_formatting_contract("p").alias("h")).first()["h"]
        assert row.select(inject("p", "MARK\nrules").alias("q")).first()["q"] == "MARK\nrules\n\nWrite."
    assert not row.select(tx.has_formatting_contract("p").alias("h")).first()["h"]


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/texlake", tmp_path / "texlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "texlake/llm/__pycache__").mkdir(parents=True)  # what a deleted package may leave behind
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert said.stdout.split()[-1:] == ["False"] and int(said.stdout.split()[-2]) > 90, said.stderr


def test_inject_block(spark):
    rows = spark.createDataFrame([("Say hi.",), (None,)], "p string").select(tx.inject_block(F.col("p"), "# Rules\nx").alias("p"))
    assert [r["p"] for r in rows.collect()] == ["# Rules\nx\n\nSay hi.", None]
    assert [r["p"] for r in rows.select(tx.inject_block(F.col("p"), "# Rules\nx").alias("p")).collect()] == ["# Rules\nx\n\nSay hi.", None]
    assert "answer" in tx.narrative_field_exemption("answer")


# --- documents -----------------------------------------------------------------------------------------------------

DOC = {"title": "H₂O", "user_id": "x₁", "link": "https://a.example/x₁", "script": "x\x00₁", "transcript": "t", "list": ["mc²", None, "/api/x₁"], "meta": {"grade": "x₁", "note": "10⁸"}, "n": 3}
SCHEMA = "title string, user_id string, link string, script string, transcript string, list array<string>, meta struct<grade:string,note:string>, n int"


def test_deep_on_columns_equals_deep_on_objects(spark):
    df = spark.createDataFrame([DOC, {**DOC, "list": None, "meta": None, "title": None}], SCHEMA)
    for given, got in zip(df.collect(), deep.fix_deep(df, narrative_keys=("script@transcript",)).collect(), strict=True):
        assert got.asDict(True) == walk.fix_deep(given.asDict(True), narrative=("script@transcript",))
    for given, got in zip(df.collect(), deep.repair_deep(df).collect(), strict=True):
        assert got.asDict(True) == walk.repair_deep(given.asDict(True))
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("d"))
    got = [json.loads(r["d"]) for r in text.select(deep.fix_json("d", narrative_keys=("script@transcript",)).alias("d")).collect()]
    assert got == [walk.fix_deep(r.asDict(True), narrative=("script@transcript",)) for r in df.collect()]


def test_deep_on_maps_and_nested_lists(spark):
    kind = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])
    df = spark.createDataFrame([({"hint": "mc²", "imageUrl": "mc²"}, [["x₁"], [], None]), (None, None)], kind)
    first, second = deep.fix_deep(df).collect()
    assert first["m"] == {"hint": "$mc^{2}$", "imageUrl": "mc²"} and first["rows"] == [["$x_{1}$"], [], None] and second["m"] is None
    with pytest.raises(ValueError, match="no columns"):
        deep.fix_deep(df, ["other"])


def test_dates_become_text(spark):
    df = spark.sql("select timestamp'2026-09-25 10:00:00' as at, timestamp'2026-09-25 10:00:00.5' as late, date'2026-01-02' as day, 'x≤5' as body")
    assert tuple(deep.canonicalize_deep(df).first()) == ("2026-09-25T10:00:00+00:00", "2026-09-25T10:00:00.500000+00:00", "2026-01-02", "$x\\leq5$")


def test_audit_paths(spark):
    df = spark.createDataFrame([(json.dumps({"a": ["ok", {"b": "x≤5"}], "raw": "≤", "id": "≤", "inner": '{"c": "H₂O"}'}, ensure_ascii=False),)], "d string")
    found = df.select(F.explode(deep.audit_json("d")).alias("f")).select("f.path", "f.kind").collect()
    assert sorted(map(tuple, found)) == [("a[1].b", "bare_unicode_math"), ("inner(json).c", "unicode_chemistry")]


def test_model_json(spark, tmp_path):
    lines = ['{"q": "\\frac{1}{2}", "n": 1}', '{"q": "tab\\there", "n": 2}', "no json"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    rows = model_json.read_model_json(spark, str(tmp_path / "a.txt"), "q string, n int").collect()
    assert [(r["q"], r["n"]) for r in rows] == [("\\frac{1}{2}", 1), ("tab\there", 2), (None, None)]
    model_json.write_model_json(spark.createDataFrame([("\\frac",)], "q string"), str(tmp_path / "out"))
    assert model_json.read_model_json(spark, str(tmp_path / "out"), "q string").first()["q"] == "\\frac"
    df = spark.createDataFrame([(lines[0],)], "t string")
    assert df.select(model_json.loads_model_json("t", "q string").alias("d")).first()["d"]["q"] == "\\frac{1}{2}"
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        spark.createDataFrame([(lines[2],)], "t string").select(model_json.loads_model_json("t", "q string")).collect()
    (tmp_path / "c.json").write_text(json.dumps({"function": "fix", "cases": [{"id": "a", "input": "x", "impl": ["other"]}, {"id": "b", "input": "y", "impl": None}]}))
    assert [r["id"] for r in model_json.read_cases(spark, str(tmp_path / "c.json"), "spark").collect()] == ["b"]


def test_answers(spark):
    left = spark.createDataFrame([("$\\frac{1}{3}$",), ("−3",), ("x",)], "a string")
    right = spark.createDataFrame([("1/3",), ("-3",)], "b string")
    assert rows_of.match_answers(left, right, "a", "b").count() == 2
    assert rows_of.match_answers(left, right, "a", "b", how="left_anti").first()["a"] == "x"
    assert rows_of.distinct_answers(left.union(right), "a").count() == 3


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "H₂O"), (2, "x≤5"), (3, "plain")], "id int, text string").selectExpr("id", "text", "timestamp'2026-01-01 00:00:00' as at").write.parquet(str(source))
    stream = spark.readStream.schema("id int, text string, at timestamp").parquet(str(source))
    query = text_streams.fixed(stream, "text").writeStream.format("memory").queryName("fixed").start()
    query.processAllAvailable()
    query.stop()
    assert {r["id"]: r["text"] for r in spark.table("fixed").collect()} == {1: "$\\text{H}_{2}\\text{O}$", 2: "$x\\leq5$", 3: "plain"}
    query = text_streams.findings_by_window(stream, "text", "at").writeStream.format("memory").queryName("kinds").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["kind"]: r["n"] for r in spark.table("kinds").collect()} == {"unicode_chemistry": 1, "bare_unicode_math": 1}


def test_entry_points():
    names = entry.queries()
    assert set(queries.queries()) <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_constant_tables(spark):
    from texlake.operators.constants import NAMES, constants

    for name in ("JOINING_CHARS", "UNICODE_MATH", "HOMOGLYPHS"):
        assert name in NAMES
        assert constants(spark, name).count() > 5
    assert constants(spark, "TYPOGRAPHIC_SPANS").where("key = '\\\\textmu'").first()["value"] == "$\\mu$"
    with pytest.raises(ValueError, match="no table"):
        constants(spark, "OTHER")


def test_gate_of_signs_holds_for_every_sign(spark):
    from texlake.tables import HOMOGLYPHS, UNICODE_MATH

    rows = spark.createDataFrame([(c,) for c in [*UNICODE_MATH, *HOMOGLYPHS, "⃗"]], "c string")
    assert rows.where(~F.col("c").rlike(gates.MATH_SIGNS)).count() == 0
    rows = spark.createDataFrame([("Größe naïve Привет 中文 “quoted” – dash",)], "c string")
    assert rows.where(F.col("c").rlike(gates.MATH_SIGNS)).count() == 0


def test_rows_of_a_task_do_not_grow_with_the_table(spark, tmp_path):
    rows_at = lambda df: [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    large = layout.spread(spark.range(0, 240_000, 1, 4), 4)
    assert len(rows_at(large)) >= 8 and max(rows_at(large)) <= 2 * layout.TASK_ROWS and large.distinct().count() == 240_000
    spark.range(0, 60_000, 1, 1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        one = spark.read.parquet(str(tmp_path / "one"))
        assert one.rdd.getNumPartitions() > 4 and len(rows_at(one)) == 1  # splits of one row group: only one has rows
        assert len(rows_at(layout.spread(one, 4))) == 4 and layout.spread(one, 4).distinct().count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for few in (spark.range(0, 40_000, 1, 4), spark.range(0)):
        assert layout.spread(few, 4) is few
