"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a name and a condition on metrics under which a text fails. ``Cascade.fit`` estimates, over a bounded sample,
each rule's selectivity (share of the sample it rejects) and cost (seconds a row), and orders the rules by rejection per
cost. A rule's cost is what the cascade adds for it: the metrics that every row gets anyway are there already, the sample
is evaluated ``repeats`` times in one job, and what a job of as many rows without the rule takes is subtracted.
``Cascade.apply`` is one CASE in that order: a row leaves it at the first rule that rejects it. The order changes the work,
never the verdict (a row is kept if no rule rejects it).

Words are runs of characters other than space and U+0009 to U+000D. A null or empty text has no words. Counting
words in repeated 3-word windows sorts the windows of a text only if some window repeats, so its cost grows as
n log n with the number of words.

Each row is judged on its own: rows that repeat an id or a whole row come back each, ids may be null. Other columns are
not read, whatever their names. An empty table gives no rows, and leaves the rules in their order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, sample_key

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a function from a metric's name to its Column, and gives the condition under which a text fails."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: The metrics that the result shows, the base rules over them, and the rules of the cascade; all must pass.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repetition", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
CASCADE = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("duplicate_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("upper_case", lambda m: 10 * m("n_upper") > 4 * m("word_chars")),
    Rule("exclamations", lambda m: 10 * m("n_exclamations") > 3 * m("n_words")),
)


def covered_by_repeats(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more."""
    n = F.size(words)
    at = lambda i: F.get(words, i)
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    # positions of the windows that have a twin: neighbours in the order of (hash, position)
    ordered = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        k = F.sequence(F.lit(0), F.size(s) - 1)
        twin = lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(k, lambda j: F.coalesce(twin(j), F.lit(False))), lambda j: F.get(s, j)["i"]))

    def covered(pos: Column) -> Column:
        gaps = F.transform(pos, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    through = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  so that c is computed once
    count = through(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(through(ordered(h), lambda s: through(repeated(s), covered))))
    return F.when(n < 4, F.lit(0)).otherwise(count).cast("long")


def metric(name: str) -> Column:
    """A metric of ``_text`` (never null) and ``_words`` (its words, without empty ones)."""
    text = F.col("_text")
    not_blank = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    without = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")
    match name:
        case "n_words":
            return F.size("_words").cast("long")
        case "word_chars":
            return F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long")
        case "n_symbols":
            return without(SYMBOLS)
        case "n_dup_lines":
            return F.get(F.transform(F.array(not_blank), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")
        case "n_lines":
            return F.size(not_blank).cast("long")
        case "n_repeat_words":
            return covered_by_repeats(F.col("_words"))
        case "n_upper":
            return F.length(F.regexp_replace(text, r"[^\p{Lu}]++", "")).cast("long")
        case "n_exclamations":
            return without("!")
    raise ValueError(f"no metric {name!r}")


def known(name: str) -> Column:
    """A metric where those in SHOWN are columns already."""
    return F.col(name) if name in SHOWN else metric(name)


def with_words(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*columns, text.alias("_text"))
    return rows.withColumn("_words", F.filter(F.split("_text", f"[{SPACE_CLASS}]+"), lambda w: w != ""))


class Cascade:
    def __init__(self, rules: tuple = CASCADE, sample_rows: int = 400, repeats: int = 60):
        self.rules, self.sample_rows, self.repeats = tuple(rules), sample_rows, repeats
        self.estimates: dict[str, tuple[float, float]] = {}  # by rule: seconds a row, share rejected

    def fit(self, docs: DataFrame) -> Cascade:
        """Order the rules by rejection per cost on about ``sample_rows`` rows, four times as many at most; an empty
        table leaves them as given. The share of ids that are sampled falls with the number of rows, so no
        partition sends more than its part of the sample. Null ids are sampled like one id."""
        share = self.sample_rows / max(docs.count(), 1)
        chosen = sample_key(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < share
        sample = with_words(docs.select("doc_id", "text").where(chosen).limit(4 * self.sample_rows), "doc_id")
        sample = sample.withColumns({m: metric(m) for m in SHOWN}).drop("doc_id").persist()
        try:
            counts = [F.count_if(rule.fails(known)).alias(f"r{k}") for k, rule in enumerate(self.rules)]
            n, *rejected = sample.agg(F.count("*"), *counts).first()
            if not n:
                return self
            again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(self.repeats))))

            def seconds(condition: Column) -> float:
                """The least of three runs; the number of the repetition takes part, so that no row is computed once only."""
                took = []
                for _ in range(3):
                    began = time.perf_counter()
                    again.agg(F.count_if(condition & (F.col("_again") > 0)), F.max(F.length("_text"))).first()
                    took.append(time.perf_counter() - began)
                return min(took)

            without = seconds(F.col("n_words") >= 0)
            for rule, hits in zip(self.rules, rejected, strict=True):
                self.estimates[rule.name] = (max(seconds(rule.fails(known)) - without, 1e-6) / (n * self.repeats), hits / n)
        finally:
            sample.unpersist()
        self.rules = tuple(sorted(self.rules, key=lambda r: (-self.estimates[r.name][1] / self.estimates[r.name][0], r.name)))
        return self

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, the metrics in SHOWN, base_failed, kept, rejected_by (the first rule in order that rejects, or
        ``base``; null if kept).

        Metrics that only the cascade reads are computed inside its branches, so rows that an earlier rule
        rejects never pay for them.
        """
        rows = with_words(docs, "doc_id").withColumns({m: metric(m) for m in SHOWN})
        failed = F.lit(False)
        for rule in BASE:
            failed = failed | rule.fails(known)
        verdict = F.when(failed, F.lit("base"))
        for rule in self.rules:
            verdict = verdict.when(rule.fails(known), F.lit(rule.name))
        rows = rows.select("doc_id", *SHOWN, failed.alias("base_failed"), verdict.alias("rejected_by"))
        return rows.select("doc_id", *SHOWN, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
