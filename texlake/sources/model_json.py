"""Answers of models: JSON text whose strings hold LaTeX, read into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def loads_latex_aware(c, schema: str | T.DataType, strict: bool = False) -> Column:
    """JSON text as a value of ``schema``, its LaTeX kept; where that fails, as a plain parser reads it; else null."""
    c = F.col(c) if isinstance(c, str) else c
    options = {"allowUnquotedControlChars": "false" if strict else "true", "mode": "PERMISSIVE"}
    return F.coalesce(F.from_json(_valid(tx.escape_latex_for_json(c)), schema, options), F.from_json(_valid(c), schema, options))


def _valid(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def loads_model_json(c, schema: str | T.DataType, lenient: bool = True) -> Column:
    """As ``loads_latex_aware`` without the second reading; text that is no JSON fails the query."""
    c = F.col(c) if isinstance(c, str) else c
    options = {"mode": "FAILFAST", "allowUnquotedControlChars": "true" if lenient else "false"}
    return F.from_json(tx.escape_latex_for_json(c) if lenient else c, schema, options)


def read_model_json(spark: SparkSession, path: str, schema: str | T.DataType, whole_files: bool = False) -> DataFrame:
    """Text files of one JSON value a line (or a file) as typed columns, with the text that was read."""
    rows = spark.read.text(path, wholetext=whole_files)
    return rows.select("value", loads_latex_aware("value", schema).alias("doc")).select("value", "doc.*")


def write_model_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def read_cases(spark: SparkSession, path: str, implementation: str | None = None) -> DataFrame:
    """Cases of expected results from JSON files {"function", "cases": [{"id", "input", ...}]}; those that name
    implementations only for the one asked for."""
    rows = spark.read.json(path, multiLine=True).select("function", F.explode("cases").alias("case")).select("function", "case.*")
    if implementation and "impl" in rows.columns:
        rows = rows.where(F.col("impl").isNull() | F.array_contains("impl", implementation))
    return rows
