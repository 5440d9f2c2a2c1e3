"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids (k-means) and a product quantiser of residuals (k-means in each of ``subspaces`` parts) are fitted
on a bounded sample, and so is the number of lists that a query visits: as many as hold ``target_recall`` of the true
neighbours within the sample. The sample has ``fit_rows`` vectors, or 16 for each list if that is more; the number of
lists grows with the root of the rows, up to ``max_lists`` (beyond some four million rows lists get longer). Every vector
is put once in the list of its nearest centroid, as the codes of its residual.

A query scans the codes of the nearest lists by an asymmetric table (its own residual against the codebook). Of each block
of a list it takes the ``per_list`` nearest, fewer the further down the list stands among those that it visits (so what it
takes in all grows with the logarithm of their number); of these the ``rerank`` nearest of all lists are ranked exactly, in
double precision, on the original vectors, which only these survivors are joined to. A query that finds fewer than ``k`` visits
four times as many lists, until it has them or has read every list.

A list is dealt in blocks of at most about ``block`` vectors and its queries in groups of about ``query_group``, so
a list that holds a third of all vectors becomes many tasks. Ties go to the smaller id, in blocks and in the merge.

Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows with a null id.
Vectors are compared with those of their own length; the index is for the most frequent length (of equally frequent ones
the largest), vectors of other lengths are ranked exactly among themselves, in the same blocks. A query never finds its
own row, but finds other rows of its id. An id that repeats stands for each of its rows, as a query and as a candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sample_key, shared_checkpoint


@dataclass(frozen=True)
class AnnParams:
    k: int = 10
    fit_rows: int = 20_000
    max_lists: int = 4096
    list_rows: int = 400
    target_recall: float = 0.97
    probe_queries: int = 300
    min_probe: int = 8
    subspaces: int = 32
    codes: int = 128
    per_list: int = 64
    rerank: int = 300
    block: int = 4096
    query_group: int = 512
    iterations: int = 12
    seed: int = 5


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, iterations: int, rng) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(iterations):
        owner = np.concatenate([squared(part, centres).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        n = np.bincount(owner, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class AnnIndex:
    centres: np.ndarray
    books: list[np.ndarray]  # a codebook for each part of the residual
    p: AnnParams
    probe: int = 1  # lists that a query visits

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([squared(part, self.centres).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])

    def share(self, place: int) -> int:
        """How many of a list are taken, by the list's place among those that a query visits."""
        return max(2, math.ceil(self.p.per_list / (1 + place / 4)))

    def nearest_cells(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """The lists from the ``first`` nearest to before the ``last`` one."""
        return np.argsort(squared(x, self.centres), axis=1, kind="stable")[:, first:last]

    def encode(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts = np.array_split(x - self.centres[cells], len(self.books), axis=1)
        return np.column_stack([squared(part, book).argmin(1) for part, book in zip(parts, self.books, strict=True)]).astype(np.uint8)

    def approximate(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to a list's codes, summed from its table."""
        parts = np.array_split(query - self.centres[cell], len(self.books))
        out = np.zeros(len(codes))
        for j, (part, book) in enumerate(zip(parts, self.books, strict=True)):
            out += ((book - part) ** 2).sum(1)[codes[:, j]]
        return out


def lists_for(rows: int, p: AnnParams) -> int:
    return int(min(p.max_lists, max(1, rows // p.list_rows), 2 * math.isqrt(max(rows, 1)) + 1))


def fit_index(x: np.ndarray, rows: int, p: AnnParams) -> AnnIndex:
    rng = np.random.default_rng(p.seed)
    lists = lists_for(rows, p)
    centres = kmeans(x, lists, p.iterations, rng)
    index = AnnIndex(centres, [], p)
    residuals = x - centres[index.cells(x)]
    some = residuals[np.sort(rng.choice(len(residuals), min(len(residuals), 48 * p.codes), replace=False))]
    parts = np.array_split(some, min(p.subspaces, x.shape[1]), axis=1)
    index.books = [kmeans(part, p.codes, p.iterations, rng) for part in parts]
    index.probe = lists_needed(x, index, rng)
    return index


def lists_needed(x: np.ndarray, index: AnnIndex, rng) -> int:
    """How many lists hold ``target_recall`` of the true neighbours of sample rows among the sample.

    Neighbours in a whole table lie nearer than those in a sample of it, so they need no more lists.
    """
    p, cells = index.p, index.cells(x)
    asked = rng.choice(len(x), min(p.probe_queries, len(x)), replace=False)
    found = []
    for q in asked:
        d = squared(x[q : q + 1], x)[0]
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(p.k, len(x) - 1)]
        place = np.empty(len(index.centres), dtype=int)
        place[np.argsort(squared(x[q : q + 1], index.centres)[0], kind="stable")] = np.arange(len(index.centres))
        found.append(place[cells[near]])
    needed = np.sort(np.concatenate(found)) if found else np.zeros(0, int)
    most = int(needed[math.ceil(p.target_recall * len(needed)) - 1]) + 1 if len(needed) else 1
    return min(len(index.centres), max(p.min_probe, most))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows


NEAR = "query_row long, query_id long, row long, vec_id long, near double"


def search(vectors: DataFrame, is_query, p: AnnParams | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found of each row for which ``is_query(vec_id)`` holds."""
    p = p or AnnParams()
    spark = vectors.sparkSession
    rows = shared_checkpoint(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    widths = rows.groupBy(F.size("v").alias("width")).count()
    common = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = common
    fit_rows = max(p.fit_rows, 16 * lists_for(total, p))
    indexed = rows.where(F.size("v") == width)
    sample = indexed.where(sample_key(F.concat_ws("/", "vec_id", "row")) < min(1.0, fit_rows / total)).limit(2 * fit_rows).toArrow()
    if not sample.num_rows:
        sample = indexed.limit(fit_rows).toArrow()
    index = fit_index(matrix(sample.sort_by([("vec_id", "ascending"), ("row", "ascending")])["v"]), total, p)
    sent = spark.sparkContext.broadcast(index)

    @F.arrow_udf("struct<cell:int,codes:binary>")
    def stored_as(v: pa.Array) -> pa.Array:
        x = matrix(v)
        cells = sent.value.cells(x) if len(x) else np.zeros(0, int)
        codes = [c.tobytes() for c in sent.value.encode(x, cells)] if len(x) else []
        return pa.StructArray.from_arrays([pa.array(cells.astype(np.int32)), pa.array(codes, pa.binary())], ["cell", "codes"])

    codes = indexed.select("row", "vec_id", stored_as("v").alias("s")).select("row", "vec_id", F.col("s.cell").alias("cell"), F.col("s.codes").alias("codes"))
    codes = shared_checkpoint(codes)
    asked = rows.where(is_query(F.col("vec_id"))).select("row", "vec_id", "v")
    pending, found, first, last = asked.where(F.size("v") == width), None, 0, index.probe
    while True:
        near = shared_checkpoint(visited(pending, codes, sent, first, last, p))
        near = near if found is None else found.union(near)
        if last >= len(index.centres):
            break
        # queries whose lists held too few go on; what they have found stays
        enough = near.groupBy("query_row").count().where(F.col("count") >= p.k).select(F.col("query_row").alias("row"))
        pending = shared_checkpoint(pending.join(enough, "row", "left_anti"))
        if pending.isEmpty():
            break
        found, first, last = near, last, 4 * last
    order = Window.partitionBy("query_row").orderBy("near", "vec_id", "row")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= p.rerank)
    other = rows.where(F.size("v") != width)
    exact = ranked(best.select("query_row", "query_id", "row", "vec_id"), rows, p)
    if len(widths.take(2)) > 1:
        exact = exact.union(ranked(scanned(other, asked.where(F.size("v") != width), p), rows, p))
    return exact


def ranked(pairs: DataFrame, rows: DataFrame, p: AnnParams) -> DataFrame:
    """The ``k`` nearest of each query row among its ``pairs``, by exact distance."""
    base, asked = rows.select("row", F.col("v").alias("bv")), rows.select(F.col("row").alias("query_row"), F.col("v").alias("qv"))

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.asarray(v.flatten()) for v in (a, b))  # the vectors of a pair are of one length
        sizes = np.asarray(pc.list_value_length(a)).astype(np.int64)
        out, ends = np.zeros(len(a)), np.cumsum(sizes)
        for width in np.unique(sizes):
            at = np.flatnonzero(sizes == width)
            places = (ends[at] - width)[:, None] + np.arange(width)
            out[at] = np.sqrt(((x[places] - y[places]) ** 2).sum(1))
        return pa.array(out, pa.float64())

    scored = pairs.join(base, "row").join(asked, "query_row").select("query_row", "query_id", "row", "vec_id", distance("bv", "qv").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return scored.withColumn("rank", place).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def dealt(base: DataFrame, asked: DataFrame, p: AnnParams) -> DataFrame:
    """Blocks of each list's vectors with groups of its queries, as keys (cell, b, g) of rows that ask or are asked.

    ``base`` and ``asked`` have cell and row beside what they carry; a list that no query visits deals nothing.
    """
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / p.query_group).alias("groups"))
    blocks = F.broadcast(shared_checkpoint(base.groupBy("cell").agg(F.ceil(F.count("*") / p.block).alias("blocks")).join(groups, "cell")))  # a row a list, or a length
    spread = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), n)
    fan = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = base.join(blocks, "cell").select("cell", spread(F.col("blocks"), 1).alias("b"), fan(F.col("groups")).alias("g"), F.lit(False).alias("asks"), F.lit(0).alias("place"), "row", "vec_id", "codes", "v")
    return left.union(asked.join(blocks, "cell").select("cell", fan(F.col("blocks")).alias("b"), spread(F.col("groups"), 2).alias("g"), F.lit(True).alias("asks"), "place", "row", "vec_id", "codes", "v"))


def halves(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(queries, candidates in the order of their ids and rows) of a dealt key."""
    asks = table["asks"]
    base = table.filter(pc.invert(asks)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
    return table.filter(asks), base


def pairs_table(found: list) -> pa.Table:
    flat = lambda k, kind: np.concatenate([x[k] for x in found]).astype(kind) if found else np.zeros(0, kind)
    return pa.table({"query_row": flat(0, np.int64), "query_id": flat(1, np.int64), "row": flat(2, np.int64), "vec_id": flat(3, np.int64), "near": flat(4, np.float64)})


def nearest_of(queries: pa.Table, base: pa.Table, distances, most) -> pa.Table:
    """The nearest candidates of each query, ``most(place)`` of them; ``distances(k)`` are those of the k-th query to all."""
    rows, ids, found = np.asarray(base["row"]), np.asarray(base["vec_id"]), []
    for k, (own, q, place) in enumerate(zip(*(queries[c].to_pylist() for c in ("row", "vec_id", "place")), strict=True)):
        near = distances(k)
        near[rows == own] = np.inf
        at = np.argsort(near, kind="stable")[: most(place)]  # of equal ones the smaller ids come first
        at = at[np.isfinite(near[at])]
        found.append((np.full(len(at), own), np.full(len(at), q), rows[at], ids[at], near[at]))
    return pairs_table(found)


def visited(asked: DataFrame, codes: DataFrame, sent, first: int, last: int, p: AnnParams) -> DataFrame:
    """What queries find in their lists from the ``first`` to before the ``last`` nearest one, by codes."""

    @F.arrow_udf("array<int>")
    def cells(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        near = sent.value.nearest_cells(matrix(v), first, last).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))

    def scan(table: pa.Table) -> pa.Table:
        queries, base = halves(table)
        if not len(queries) or not len(base):
            return pairs_table([])
        ann, own, x = sent.value, table["cell"][0].as_py(), matrix(queries["v"])
        kept = np.frombuffer(b"".join(base["codes"].to_pylist()), np.uint8).reshape(len(base), -1)
        return nearest_of(queries, base, lambda k: ann.approximate(x[k], own, kept), ann.share)

    stored = codes.withColumn("v", F.lit(None).cast("array<double>"))
    visits = shared_checkpoint(asked.select("row", "vec_id", "v", F.lit(None).cast("binary").alias("codes"), F.posexplode(cells("v")).alias("at", "cell")))
    visits = visits.withColumn("place", F.col("at") + first)
    return dealt(stored, visits, p).groupBy("cell", "b", "g").applyInArrow(scan, NEAR)


def scanned(base: DataFrame, asked: DataFrame, p: AnnParams) -> DataFrame:
    """What queries find among the vectors of their own length, by exact distance; ``cell`` is the length here."""

    def scan(table: pa.Table) -> pa.Table:
        queries, others = halves(table)
        if not len(queries) or not len(others):
            return pairs_table([])
        x, y = matrix(queries["v"]), matrix(others["v"])
        return nearest_of(queries, others, lambda k: np.sqrt(((y - x[k]) ** 2).sum(1)), lambda place: p.k)

    of = lambda rows: rows.select("row", "vec_id", "v", F.lit(None).cast("binary").alias("codes"), F.size("v").alias("cell"), F.lit(0).alias("place"))
    return dealt(of(base), of(asked), p).groupBy("cell", "b", "g").applyInArrow(scan, NEAR).select("query_row", "query_id", "row", "vec_id")
