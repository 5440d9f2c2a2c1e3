"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a few aggregations and joins; steps repeat until no edge changes. Edges and labels stay
distributed, checkpointed between steps. A node with very many neighbours costs partial minima and a join
whose partitions adaptive execution may split, never one task's memory. A table that is counted and has no more than
``at_once`` edges, a megabyte or so, is labelled in one task instead: there, steps would be nothing but overhead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_steps: int = 60, at_once: int = 1 << 16) -> DataFrame:
    """(node, component) for every node of ``edges``; a component's name is its smallest node.

    Null ends and edges from a node to itself link nothing; repeated edges count once. Nodes without edges
    are not in the result. An edge table that is empty gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = shared_checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, before = e.count(), None
    if n == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if n <= at_once:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_labelled, f"node {kind}, component {kind}")
    for _ in range(max_steps):
        # large star: each node's larger neighbours hang on the smallest node around it
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: each node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = shared_checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # each node hangs on one smaller node once the edges are stars; then the set of edges stays as it is
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {max_steps} steps")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _labelled(batches):
    """All edges of one bounded table: hang the larger of two roots on the smaller one, until no edge joins two roots."""
    ends = [pa.concat_arrays(x) for x in zip(*[(b.column(0), b.column(1)) for b in batches if b.num_rows], strict=True)]
    if not ends:
        return
    both = pa.concat_arrays(ends)
    nodes, place = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
    u, v = place[: len(ends[0])], place[len(ends[0]) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((deeper := root[root]) != root).any():
            root = deeper
    kind = both.type
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], names=["node", "component"])
