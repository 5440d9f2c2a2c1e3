"""Kernels over strings as Arrow functions.

A kernel sees each distinct string of a batch once. It gets null for the rows that its gate excludes: an
expression around a Python function does not keep rows from it, a null does.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def each_distinct(texts: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    encoded = texts.dictionary_encode()
    results = pa.array([f(x) for x in encoded.dictionary.to_pylist()], kind)
    return results.take(encoded.indices)


def kernel(f: Callable, returns: str | T.DataType = "string"):
    """``f`` over one string as a function of a string column."""
    spark_type = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    kind = to_arrow_type(spark_type)

    def run(texts: pa.Array) -> pa.Array:
        return each_distinct(texts, f, kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=spark_type)


def gated(c: Column, f: Callable, gate: Callable[[Column], Column]) -> Column:
    """A string rewritten by ``f`` where the gate holds, and as it is elsewhere."""
    return F.coalesce(kernel(f)(F.when(gate(c), c)), c)
