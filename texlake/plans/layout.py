"""How rows lie across tasks before work that Python does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task: with kernels at half a millisecond a row, some ten seconds; a shuffled task of them costs far less.
TASK_ROWS = 25_000


def spread(df: DataFrame, least: int | None = None, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` over at least as many partitions as tasks run at once, and over so many that none has more than about ``rows``.

    For kernels that cost far more than moving their rows: a row group of a file is one task otherwise, and the splits of
    a large file are as long as the file is. Rows are counted first where they lie, without columns, as splits that
    begin no row group are empty. A table that lies well already is left as it is and not shuffled.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    at = df.select(F.spark_partition_id().alias("at")).groupBy("at").count()
    filled, most, total = at.agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if total <= 1 or filled >= least and most <= 2 * rows:
        return df
    return df.repartition(max(least, -(-total // rows)))
