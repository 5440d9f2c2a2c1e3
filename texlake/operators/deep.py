"""Rewrites and audits of documents: typed columns by their schema, JSON text by parsing it.

Which columns to touch is decided from the schema when the plan is built, so columns and struct fields that
hold no text to be rewritten never reach Python, and a column without any is left alone. Within a nested
column the kernel works on Arrow arrays, all strings of a field at once, whatever lists they lie in.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..kernels import walk
from ..kernels.fixing import fix
from ..kernels.mend import repair
from ..kernels.write import canonicalize
from ..plans import gates
from ..plans.kernels import each_distinct, kernel

PATH_FINDING = "struct<path string, kind string, position int, snippet string>"


def has_content(kind: T.DataType, key: str, every: bool = False) -> bool:
    """Whether a value of this type may hold text to be rewritten."""
    match kind:
        case T.StringType():
            return every or not walk.is_non_content_key(key)
        case T.ArrayType():
            return has_content(kind.elementType, key, every)
        case T.MapType():
            return has_content(kind.valueType, "", every)
        case T.StructType():
            return any(has_content(f.dataType, f.name, every) for f in kind.fields)
    return False


def _leaves(f: Callable, every: bool) -> Callable:
    return f if every else lambda t: t if t is None or walk.is_url_or_path(t) else f(t)


def rewrite_array(values: pa.Array, f: Callable, key: str, narrative: tuple, every: bool) -> pa.Array:
    """``f`` over the content strings of an Arrow array of any nesting."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return values if not every and walk.is_non_content_key(key) else each_distinct(values, _leaves(f, every), kind)
    if pa.types.is_struct(kind):
        names = [field.name for field in kind]
        fields = []
        for name, field in zip(names, kind, strict=True):
            child = values.field(name)
            spoken = not every and walk.is_narrative_key(name, names, narrative)
            fields.append(rewrite_array(child, repair if spoken else f, name, narrative, every or spoken).cast(field.type))
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pc.is_null(values))
    if pa.types.is_map(kind):
        return _rewrite_map(values, f, narrative, every)
    if pa.types.is_list(kind):
        values = pa.concat_arrays([values]) if values.offset else values
        inner = rewrite_array(values.values, f, key, narrative, every)
        return pa.ListArray.from_arrays(values.offsets, inner, type=kind, mask=pc.is_null(values))
    return values


def _rewrite_map(values: pa.Array, f: Callable, narrative: tuple, every: bool) -> pa.Array:
    """Keys are data here: the values of each distinct key are rewritten at once, by what the key says."""
    values = pa.concat_arrays([values]) if values.offset else values
    low, high = (values.offsets[0].as_py(), values.offsets[-1].as_py()) if len(values.offsets) else (0, 0)
    keys, items = values.keys.slice(low, high - low), values.items.slice(low, high - low)
    row = np.repeat(np.arange(len(values)), np.diff(np.asarray(values.offsets)))
    encoded = keys.dictionary_encode()
    of, names = np.asarray(encoded.indices), encoded.dictionary.to_pylist()
    beside = {s: np.isin(row, row[of == k]) for k, s in enumerate(names) if any(e.endswith(f"@{s}") for e in narrative)}
    parts, places = [], []

    def rewritten(at: np.ndarray, apply: Callable, key: str, whole: bool) -> None:
        if len(at):
            parts.append(rewrite_array(items.take(pa.array(at)), apply, key, narrative, whole).cast(items.type))
            places.append(at)

    for k, name in enumerate(names):
        spoken = np.full(len(of), every)
        for entry in narrative:
            key, _, sibling = entry.partition("@")
            if key == name:
                spoken |= beside.get(sibling, False) if sibling else True
        rewritten(np.flatnonzero((of == k) & spoken), repair, name, True)
        rewritten(np.flatnonzero((of == k) & ~spoken), f, name, False)
    if parts:
        items = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))
    offsets = pa.array(np.asarray(values.offsets) - low, pa.int32())
    return pa.MapArray.from_arrays(offsets, keys, items, type=values.type, mask=pc.is_null(values))


def _any_text(c: Column, kind: T.DataType, holds: Callable[[Column], Column]) -> Column:
    """Whether ``holds`` does for a string anywhere in a value; what no string is in is false."""
    match kind:
        case T.StringType():
            return F.coalesce(holds(c), F.lit(False))
        case T.ArrayType():
            return F.coalesce(F.exists(c, lambda x: _any_text(x, kind.elementType, holds)), F.lit(False))
        case T.MapType():
            return F.coalesce(F.exists(F.map_values(c), lambda x: _any_text(x, kind.valueType, holds)), F.lit(False))
        case T.StructType():
            out = F.lit(False)
            for field in kind.fields:
                if _has_text(field.dataType):
                    out = out | _any_text(c[field.name], field.dataType, holds)
            return out
    return F.lit(False)


def _has_text(kind: T.DataType) -> bool:
    return has_content(kind, "", every=True)


def _rewrite_columns(df: DataFrame, f: Callable, gate, cols, narrative: tuple, every: bool = False) -> DataFrame:
    names = list(cols or df.columns)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no columns {unknown}")
    out = {}
    for field in df.schema.fields:
        spoken = not every and walk.is_narrative_key(field.name, df.columns, narrative)
        if field.name not in names or not has_content(field.dataType, field.name, every or spoken):
            continue
        c, apply = F.col(f"`{field.name}`"), repair if spoken else f
        if isinstance(field.dataType, T.StringType):
            if spoken or every:
                out[field.name] = tx.repair(c)
            else:
                out[field.name] = F.coalesce(gate(F.when(~tx.is_url_or_path(c), c)), c)
            continue
        run = partial(_run, f=apply, key=field.name, narrative=narrative, every=every or spoken)
        # rows without a string that the functions may change stay in the JVM
        touched = _any_text(c, field.dataType, gates.repair if every or spoken else gates.fix)
        out[field.name] = F.when(touched, _nested(run, field.dataType)(F.when(touched, c))).otherwise(c)
    return df.withColumns(out) if out else df


def _run(values: pa.Array, f, key, narrative, every) -> pa.Array:
    return rewrite_array(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values, f, key, narrative, every)


def _nested(run: Callable, kind: T.DataType):
    def apply(values: pa.Array) -> pa.Array:
        return run(values)

    return F.arrow_udf(apply, returnType=kind)


def fix_deep(df: DataFrame, cols=None, chemistry: bool = True, narrative_keys=()) -> DataFrame:
    """``fix`` over the content of the columns; columns under narrative keys are only repaired.

    Null values stay null; keys, urls and paths stay as they are; a list has the key of its column or field.
    """
    return _rewrite_columns(df, partial(fix, chemistry=chemistry), partial(tx.fix, chemistry=chemistry), cols, tuple(narrative_keys))


def repair_deep(df: DataFrame, cols=None) -> DataFrame:
    """``repair`` over every string of the columns, whatever its key."""
    return _rewrite_columns(df, repair, tx.repair, cols, (), every=True)


def _iso(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def canonicalize_deep(df: DataFrame, cols=None, chemistry: bool = True, narrative_keys=()) -> DataFrame:
    """``canonicalize`` over the content, and dates and timestamps as ISO-8601 text (in the session's zone)."""
    out = _rewrite_columns(df, partial(canonicalize, chemistry=chemistry), partial(tx.canonicalize, chemistry=chemistry), cols, tuple(narrative_keys))
    names = set(cols or df.columns)
    dated = {}
    for field in df.schema.fields:
        if field.name in names and isinstance(field.dataType, T.DateType):
            dated[field.name] = F.col(f"`{field.name}`").cast("string")
        elif field.name in names and isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            dated[field.name] = _iso(F.col(f"`{field.name}`").cast("timestamp"))
    return out.withColumns(dated) if dated else out


def _dumps(node) -> str:
    return json.dumps(node, ensure_ascii=False)


def _json(text, f):
    if text is None:
        return None
    try:
        node = json.loads(text)
    except ValueError:
        return text
    return _dumps(f(node))


def fix_json(c, chemistry: bool = True, narrative_keys=()) -> Column:
    """``fix`` over the content of a column of JSON text; text that is no JSON stays as it is."""
    f = partial(walk.fix_deep, chemistry=chemistry, narrative=tuple(narrative_keys))
    return kernel(partial(_json, f=f))(F.col(c) if isinstance(c, str) else c)


def canonicalize_json(c, chemistry: bool = True, narrative_keys=()) -> Column:
    f = partial(walk.canonicalize_deep, chemistry=chemistry, narrative=tuple(narrative_keys))
    return kernel(partial(_json, f=f))(F.col(c) if isinstance(c, str) else c)


def _audit_json(text):
    if text is None:
        return None
    try:
        node = json.loads(text)
    except ValueError:
        node = text
    return [{"path": path, **f._asdict()} for path, f in walk.audit_deep(node)]


def audit_json(c) -> Column:
    """Findings with the path of their field, of a column of JSON text."""
    found = kernel(_audit_json, f"array<{PATH_FINDING}>")(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(found, F.array().cast(f"array<{PATH_FINDING}>"))


LEAVES = "array<struct<path string, text string>>"


def _or_none(leaves: Column | None) -> Column:
    return F.array().cast(LEAVES) if leaves is None else leaves


def _string_leaves(c: Column, kind: T.DataType, key, path: Column) -> Column | None:
    """The rendered strings of a value with their paths, as an array of (path, text); None where there can be none.

    ``key`` is a name where the schema says it, a column where a map does.
    """
    match kind:
        case T.StringType():
            if isinstance(key, str) and (walk.is_non_content_key(key) or walk.is_not_rendered_key(key)):
                return None
            rendered = c.isNotNull() & ~tx.is_url_or_path(c)
            if not isinstance(key, str):
                rendered = rendered & ~tx.is_non_content_key(key) & ~tx.is_not_rendered_key(key)
            return F.when(rendered, F.array(F.struct(path.alias("path"), c.alias("text")))).otherwise(_or_none(None))
        case T.ArrayType() if _has_text(kind):
            item = lambda x, i: _or_none(_string_leaves(x, kind.elementType, key, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.coalesce(F.flatten(F.transform(c, item)), _or_none(None))
        case T.MapType() if _has_text(kind):
            name = lambda e: e["key"].cast("string")
            entry = lambda e: _or_none(_string_leaves(e["value"], kind.valueType, name(e), F.concat(path, F.lit("."), name(e))))
            return F.coalesce(F.flatten(F.transform(F.map_entries(c), entry)), _or_none(None))
        case T.StructType():
            found = [_string_leaves(c[f.name], f.dataType, f.name, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
            found = [x for x in found if x is not None]
            return F.coalesce(F.concat(*found), _or_none(None)) if found else None
    return None


def _audit_leaf(text):
    """Findings in a string, or in the strings of the JSON document that it is."""
    return None if text is None else [{"path": path, **f._asdict()} for path, f in walk.audit_deep(text)]


def audit_deep(df: DataFrame, cols=None, keep=()) -> DataFrame:
    """A row a finding: the ``keep`` columns, then path, kind, position, snippet.

    The schema says where strings may be; they are listed with their paths in the JVM, and only those that an audit
    looks into, or that may be JSON documents, go to Python.
    """
    fields = [df.schema[n] for n in (cols or df.columns)]
    found = [_string_leaves(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f.name)) for f in fields]
    found = [x for x in found if x is not None]
    leaves = F.concat(*found) if found else _or_none(None)
    rows = df.select(*keep, F.explode(leaves).alias("_leaf")).where(gates.document(F.col("_leaf.text")))
    rows = rows.select(*keep, "_leaf.path", F.explode(kernel(_audit_leaf, f"array<{PATH_FINDING}>")(F.col("_leaf.text"))).alias("_f"))
    return rows.select(*keep, F.concat("path", "_f.path").alias("path"), "_f.kind", "_f.position", "_f.snippet")
