"""The vocabularies and character tables as small DataFrames, for joins and for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

NAMES = (
    "BEHIND_JSON_ESCAPES COLLISION_COMMANDS KNOWN_COMMANDS PROSE_COMMANDS COLLAPSIBLE SYMBOL_COMMANDS JOINING_COMMANDS STRUCTURAL_COMMANDS "
    "DECLARATION_COMMANDS ARGUMENT_COMMANDS SCRIPT_LABELS LOST_ESCAPE_RUNS UNIT_BASES ELEMENT_SYMBOLS GREEK_MATH_LETTERS GREEK_UNIT_SYMBOLS "
    "JOINING_CHARS WRAPPABLE NON_CONTENT_KEYS NON_CONTENT_SUFFIXES NOT_RENDERED_KEYS URL_PREFIXES FILE_EXTENSIONS UNICODE_MATH HOMOGLYPHS "
    "MOJIBAKE NAMED_ENTITIES COMMAND_TEXT COMPARE_FOLD TYPOGRAPHIC_SPANS COMMAND_TYPOS"
).split()


def constants(spark: SparkSession, name: str) -> DataFrame:
    """(key, value) of a table, (key, null) of a set; ordered by key."""
    if name not in NAMES:
        raise ValueError(f"no table {name!r}; there are {', '.join(NAMES)}")
    table = getattr(tables, name)
    rows = sorted(table.items()) if isinstance(table, dict) else [(k, None) for k in sorted(table)]
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v in rows]
    return spark.range(1).select(F.explode(F.array(*pairs)).alias("r")).select("r.*")
