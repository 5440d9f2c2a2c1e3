"""Findings as rows, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..kernels.findings import ALL_KINDS


def audit_table(df: DataFrame, text: str, keep=()) -> DataFrame:
    """A row a finding, with the ``keep`` columns of its text. The audit runs once a row, behind its gate."""
    rows = df.select(*keep, F.explode(tx.audit(F.col(text))).alias("_f"))
    return rows.select(*keep, "_f.kind", "_f.position", "_f.snippet")


def count_by_kind(findings: DataFrame, *by: str) -> DataFrame:
    """Number of findings of each kind that occurs (of each group), in the order of the kinds."""
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    return findings.groupBy(*by, "kind").agg(F.count("*").alias("n")).orderBy(*by, order)


def segments_table(df: DataFrame, text: str, key: str) -> DataFrame:
    """A row a segment, with its number and its place by code points."""
    rows = df.select(key, F.posexplode(tx.segment(F.col(text))).alias("idx", "_s"))
    return rows.select(key, "idx", "_s.kind", "_s.display", "_s.value", "_s.raw")


def amounts(df: DataFrame, text: str, keep=()) -> DataFrame:
    """A row an amount of money, with its number."""
    rows = df.select(*keep, F.explode(tx.currency_spans(F.col(text))).alias("_m"))
    number = F.regexp_replace(F.regexp_extract("_m.text", r"([0-9][0-9,]*(?:\.[0-9]+)?)$", 1), ",", "").cast("decimal(38,2)")
    return rows.select(*keep, "_m.start", "_m.end", "_m.text", number.alias("amount"))


def match_answers(left: DataFrame, right: DataFrame, left_answer: str, right_answer: str, on=(), how: str = "inner") -> DataFrame:
    """Join of answers that are equal as answers. Each side's key is computed once, before the join, so
    it is an equi-join: Spark picks its kind, and adaptive execution splits skewed keys."""
    a = left.withColumn("answer_key", tx.compare_key(F.col(left_answer)))
    b = right.withColumn("answer_key", tx.compare_key(F.col(right_answer)))
    return a.join(b, [*on, "answer_key"], how)


def distinct_answers(df: DataFrame, answer: str, *by: str) -> DataFrame:
    """One row for each distinct answer: its key and how many rows gave it."""
    return df.select(*by, tx.compare_key(F.col(answer)).alias("answer_key")).groupBy(*by, "answer_key").agg(F.count("*").alias("n"))


def share_needing_fix(df: DataFrame, text: str) -> Column:
    return F.avg(tx.needs_fix(F.col(text)).cast("double"))
