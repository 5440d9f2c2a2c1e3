"""The functions on streams: they keep no state, so a projection is the same on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.findings import audit_table


def fixed(stream: DataFrame, text: str, chemistry: bool = True) -> DataFrame:
    """The stream with its text column fixed; columns and watermark stay."""
    return stream.withColumn(text, tx.fix(F.col(text), chemistry))


def findings_by_window(stream: DataFrame, text: str, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by kind and window of event time; rows later than ``late`` behind the watermark are not counted."""
    found = audit_table(stream.withWatermark(time, late), text, keep=(time,))
    return found.groupBy(F.window(time, window), "kind").agg(F.count("*").alias("n"))
