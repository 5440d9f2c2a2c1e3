"""Helpers shared by the operators: shared checkpoints, bounded samples, columnar tokenisation.

Conventions that every operator here follows:

* it reads only the columns it names, so extra columns (also ones that carry the names of output columns)
  never reach its result;
* a null text counts as an empty text unless the operator says otherwise;
* repeated rows are separate rows; ties are broken by values, never by arrival order.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker: bounds the worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20
#: The words of a text are runs of anything but these characters.
SPACE_CLASS = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error,
    because its executors share no other folder.
    """
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        folder = tempfile.mkdtemp(dir="/tmp/checkpoints")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; Spark drops the files with the last reference."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the folds that keep training rows and held-out rows apart."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def sample_key(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, class_col: str, per_class: int, max_classes: int = 256, total: int | None = None) -> tuple[DataFrame, dict]:
    """At most about ``per_class`` rows of each class (by hash of doc_id), and all classes' row counts.

    ``rows`` has doc_id and ``class_col``. Only the ``max_classes`` most frequent classes are sampled; with ``total``, each
    class gets at most its equal part of so many rows. The counts come from all rows; the sample keeps the rows whose hash
    lies below each class's share, so no class is ordered or gathered as a whole.
    """
    counted = rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count()
    counts = {r[0]: r[1] for r in counted.orderBy(F.desc("count"), class_col).limit(max_classes).collect()}
    per = per_class if total is None else min(per_class, max(1, total // max(len(counts), 1)))
    kind = rows.schema[class_col].dataType.simpleString()
    shares = rows.sparkSession.createDataFrame([(value, min(1.0, per / max(n, 1))) for value, n in counts.items()], f"_class {kind}, _share double")
    chosen = rows.join(F.broadcast(shares), F.col(class_col) == F.col("_class")).where(sample_key(F.col("doc_id")) < F.col("_share"))
    return chosen.drop("_class", "_share"), counts


def slice_of(text: Column, doc_id: Column, limit: int) -> Column:
    """``text``, or of a longer one the ``limit`` characters from a place that depends on its id."""
    start = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("slice")), F.length(text) - limit + 1) + 1
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(text, start.cast("int"), F.lit(limit)))


def release_memory() -> None:
    """Give back what training on the driver has freed: allocators keep it otherwise, beside the driver's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, slice) pieces of a string array, of about ``limit`` bytes each (a single longer text: alone)."""
    if len(texts) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def as_strings(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of each text, dictionary-encoded: (distinct words, code of each word, first word of each text).

    The offsets have one more entry than there are texts.
    """
    texts = as_strings(texts)
    if lower:
        texts = pc.utf8_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    lengths = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    encoded = parts.flatten().dictionary_encode()
    distinct, codes = encoded.dictionary, np.asarray(encoded.indices)
    empty = pc.index(distinct, "").as_py() if len(distinct) else -1
    if empty >= 0:
        kept = codes != empty
        rows = np.repeat(np.arange(len(lengths)), lengths)[kept]
        lengths = np.bincount(rows, minlength=len(lengths))
        codes = codes[kept]
    return distinct, codes, np.concatenate([[0], np.cumsum(lengths)])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along axis 0; empty segments give zeros."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers (shift-xor-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_strings(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    import pandas as pd

    if not len(distinct):
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.asarray(distinct.to_pandas(), dtype=object), categorize=False)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
