"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time t in [0, 1], a straight line from its weight times
``start_tilt`` to its weight times ``end_tilt`` (schedules of sources with an odd place in the order run the
other way, so the mixture shifts while it trains). Its integral is the source's cumulative demand; inverted, it
turns the token at which a document begins in its source into the training position at which it is read.
Documents are then range-sorted by position.

A source's target is its weight's share of ``total_share`` times all sizes, at most ``max_repeats`` times its own
size; what exceeds that is shared again by weight. The source's documents are read in an order given by a hash
of doc_id (then text), again from the start after a whole pass, up to the target; the document at which the
target is reached is taken in part, so taken words meet the rounded target exactly.

Running sums inside a source go in two steps (sums of ``slots`` hash ranges, then within a range), so a hot
source is spread over as many tasks as it has ranges. A null text has size 0; a null source comes last; a
source of size 0 takes nothing. Repeated rows count each; equal rows may swap places, which changes no row. The table of
sources, a row each, is ordered in one task; it has no text, so millions of sources are some hundred MB there at most.
Extra columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, shared_checkpoint


@dataclass(frozen=True)
class MixParams:
    weights: tuple = (3, 1, 2)
    total_share: float = 1.5
    max_repeats: int = 2
    slots: int = 4096
    start_tilt: float = 1.5
    end_tilt: float = 0.5
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]++")), F.lit(0)).cast("long")


def source_targets(slots: DataFrame, p: MixParams) -> DataFrame:
    """A row a source: source, source_size, place (from 0 by code point, null last), target, all_targets.

    The level at which all capped and uncapped sources add up to the total is found by ordering the sources by
    the level at which each one reaches its cap. This table has a row a source, not a document.
    """
    sizes = slots.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in p.weights])
    rows = sizes.withColumn("place", place).withColumn("weight", F.get(cycle, (F.col("place") % len(p.weights)).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(p.max_repeats)).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(p.total_share))
    capped, open_weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("total") - capped) / open_weight)
    # the first source, by the level that fills it, which isn't full at the level left for it and those after it
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everything)
    rows = rows.withColumn("target", F.least("cap", F.coalesce(level["level"] * F.col("weight"), F.col("cap"))))
    return rows.select("source", "source_size", "place", "target", F.sum("target").over(everything).alias("all_targets"))


def invert_demand(share: Column, start: Column, end: Column) -> Column:
    """The time t at which the integral of a weight that goes straight from ``start`` to ``end`` is ``share`` of its whole."""
    whole = (start + end) / 2
    slope = end - start
    root = F.sqrt(F.greatest(start * start + 2 * slope * share * whole, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, share).otherwise(2 * share * whole / (start + root))


def mix(docs: DataFrame, p: MixParams | None = None, carry: tuple = ()) -> DataFrame:
    """One row a row of ``docs``: doc_id, source, size, source_size, target, taken, positions (the training position,
    in words, of each pass that takes words of it, in order), and the columns named in ``carry``."""
    p = p or MixParams()
    key = F.md5(F.concat_ws(":", F.lit(p.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *carry)
    sized = sized.withColumn("_slot", (F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") * p.slots / 65536).cast("int"))
    if not carry:
        sized = shared_checkpoint(sized)
    slots = shared_checkpoint(sized.groupBy("source", "_slot").agg(F.sum("size").alias("words")))
    earlier = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slots.select(F.col("source").alias("s"), F.col("_slot").alias("_at"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_base"))
    targets = source_targets(slots, p)
    bases = bases.join(targets, bases["s"].eqNullSafe(targets["source"])).drop("source")
    rows = sized.join(bases, sized["source"].eqNullSafe(bases["s"]) & (sized["_slot"] == bases["_at"]))
    inside = Window.partitionBy("source", "_slot").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.round("target").cast("long")
    begins = [F.col("_start") + F.lit(k) * F.col("source_size") for k in range(p.max_repeats)]
    takes = [F.least("size", F.greatest(goal - begin, F.lit(0))) for begin in begins]
    odd = F.col("place") % 2 == 1
    start, end = F.when(odd, p.end_tilt).otherwise(p.start_tilt), F.when(odd, p.start_tilt).otherwise(p.end_tilt)
    at = [F.when(take > 0, invert_demand(F.try_divide(begin, "target"), start, end) * F.col("all_targets")) for begin, take in zip(begins, takes, strict=True)]
    rows = rows.withColumn("taken", sum(takes[1:], takes[0]).cast("long")).withColumn("positions", F.array_compact(F.array(*at)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", *carry)


def training_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Rows range-sorted by training position, in as many partitions as Spark finds fit; rows that are never read
    come last."""
    order = [F.col(position).asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def apply_mix(docs: DataFrame, p: MixParams | None = None) -> DataFrame:
    """``docs`` as the mix reads them, in training order: a document once for each pass that takes words of it.

    The document in which a source's target falls is read whole, as documents are not cut here. Columns stay
    as they are; rows of documents without words, and of those the mix does not reach, go.
    """
    mixed = mix(docs.withColumn("_row", F.struct(*docs.columns)), p, carry=("_row",))
    return training_order(mixed.select("doc_id", "_row", F.explode("positions").alias("position"))).select("_row.*")
