"""Near duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its k-mers: runs of ``k`` = 5 lower-cased words (a text of 1 to 4 words is one k-mer;
a text without words, also a null one, has none and is never a duplicate). Each k-mer carries its occurrence
number in the text, so labelled k-mers are distinct within a text. For each of ``sketches`` hash functions the
``per_sketch`` smallest labelled k-mers are taken and put in text order; texts that share such a tuple are
candidates. So reordered texts collide less than edited ones.

Two candidates are near duplicates if aligned k-mers / (all k-mers of both - aligned k-mers) >= ``similarity``
= 0.8, where the alignment is the longest common subsequence of labelled k-mers inside a band: at this
similarity the two texts differ by at most (n + m) / 9 k-mers, so no pair of positions further apart than that
can be aligned, and the band loses nothing.

Rows with equal k-mer sequences collapse into a class before any pair is made. A bucket of up to ``small_bucket``
classes gives all its pairs (a constant bound); a larger one gives a star around its first class. Where a large
bucket then still spans several components, an exact filter finds what may yet be linked: two texts of similarity
s share one of the n - ceil(s n) + 1 rarest k-mers of the longer and one of the n - ceil(2 s n / (1 + s)) + 1 rarest
of the shorter, rarity being the number of classes here that hold a k-mer. So a passage that many texts share makes
no candidates, and a text whose rare k-mers are its own drops out. What remains falls into families (classes joined
through such k-mers); in a family, the classes outside its largest component are compared with all others in blocks
of bounded bytes. Every candidate pair is thus linked, excluded by the filter, or compared; pairs in one component
are skipped. Links between classes of a family that share no tuple count as well.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_strings, hash_strings, mix64, shared_checkpoint, text_slices, words_of
from .components import connected_components


@dataclass(frozen=True)
class DedupParams:
    k: int = 5
    similarity: float = 0.8
    sketches: int = 16
    per_sketch: int = 3
    small_bucket: int = 8
    block: int = 512  # classes in a block of a family, and the k-mers that they may hold together
    block_kmers: int = 1 << 20
    seed: int = 11


def kmers(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; one of all words if there are fewer, none if there are none."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = mix64(out ^ word_hashes[j : j + len(out)])
    return out


def labelled(kmer_hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of the same k-mer apart."""
    n = len(kmer_hashes)
    order = np.argsort(kmer_hashes, kind="stable")
    ordered = kmer_hashes[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    if starts.all():
        return kmer_hashes
    first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    number = np.empty(n, dtype=np.uint64)
    number[order] = (np.arange(n) - first).astype(np.uint64)
    return np.where(number > 0, mix64(kmer_hashes ^ mix64(number)), kmer_hashes)


def sequences(texts: pa.Array, k: int):
    """The labelled k-mer hashes of each text, in text order."""
    for _, part in text_slices(texts):
        distinct, codes, offsets = words_of(part, lower=True)
        hashes = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        for i in range(len(part)):
            yield labelled(kmers(hashes[offsets[i] : offsets[i + 1]], k))


def fingerprint(seq: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence: equal sequences, equal bits."""
    at = mix64(np.arange(1, len(seq) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        a, b = (seq * (at | np.uint64(1))).sum(dtype=np.uint64), mix64(seq ^ at).sum(dtype=np.uint64)
    return tuple(np.array([a, b], dtype=np.uint64).view(np.int64).tolist())


def order_sketch(seq: np.ndarray, p: DedupParams) -> np.ndarray:
    """One 64-bit key per hash function: its smallest labelled k-mers in text order."""
    seeds = mix64(np.arange(1, p.sketches + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(p.seed))
    n, take = len(seq), min(p.per_sketch, len(seq))
    mixed = mix64(seq[None, :] ^ seeds[:, None])
    if n > take:
        at = np.sort(np.argpartition(mixed, take - 1, axis=1)[:, :take], axis=1)
    else:
        at = np.broadcast_to(np.arange(n), (p.sketches, n))
    key = seeds.copy()
    for j in range(take):
        key = mix64(key ^ seq[at[:, j]])
    return key.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned share of two sequences of distinct items, by the longest common subsequence within the band.

    Exact for similarities of ``least`` or more; below, it may give less than the unbanded alignment does.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    order = np.argsort(b)
    ordered = b[order]
    at = np.minimum(np.searchsorted(ordered, a), m - 1)
    i = np.flatnonzero(ordered[at] == a)
    j = order[at[i]]
    band = (1 - least) / (1 + least) * (n + m) + 1e-9
    j = j[np.abs(j - i) <= band]
    if len(j) < least * (n + m - len(j)) - 1e-9:
        return 0.0
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        common = len(j)
    else:  # matches come in the order of a; the longest rising run of positions in b is the alignment
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    return common / (n + m - common)


SKETCH = "doc_id long, h1 long, h2 long, n_kmers int, keys array<long>"


def sketch(docs: DataFrame, p: DedupParams) -> DataFrame:
    """One slim row a row of ``docs``: doc_id, its 128-bit fingerprint, number of k-mers and sketch keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_kmers", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def of(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, keys = [], []
            for seq in sequences(as_strings(batch.column(1)), p.k):
                rows.append((*fingerprint(seq), len(seq)))
                keys.append(order_sketch(seq, p) if len(seq) else np.zeros(0, np.int64))
            h1, h2, n = zip(*rows, strict=True) if rows else ((), (), ())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            arrays = [pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, SKETCH)


@dataclass(frozen=True)
class Classes:
    """The distinct k-mer sequences of a table.

    ``rows``: a row a document (doc_id, row, h1, h2, n_kmers). ``classes``: node (a number of its own), doc_id (the smallest
    one), row (one row of that doc_id), h1, h2, n, keys. ``repeated``: the ids of several rows, and null; None if there are none.
    """

    rows: DataFrame
    classes: DataFrame
    repeated: DataFrame | None


def classes_of(docs: DataFrame, p: DedupParams) -> Classes:
    rows = shared_checkpoint(sketch(docs, p).withColumn("row", F.monotonically_increasing_id()))
    grouped = rows.where("n_kmers > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.min_by("row", "doc_id").alias("row"), F.first("n_kmers").alias("n"), F.first("keys").alias("keys")
    )
    classes = shared_checkpoint(grouped.withColumn("row", F.coalesce("row", "node")))
    repeated = shared_checkpoint(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    return Classes(rows, classes, None if repeated.isEmpty() else repeated)


def split_by_id(wanted: DataFrame, c: Classes) -> tuple[DataFrame, DataFrame | None]:
    """``wanted`` (with doc_id) in two parts: ids of one row, and ids of several rows or null."""
    if c.repeated is None:
        return wanted, None
    many = c.repeated.withColumnRenamed("doc_id", "many_id")
    same = F.col("doc_id").eqNullSafe(F.col("many_id"))
    return wanted.join(many, same, "left_anti"), wanted.join(many, same, "left_semi")


def fingerprints(p: DedupParams):
    """A column function of text: struct (h1, h2, n_kmers)."""

    @F.arrow_udf("struct<h1:bigint,h2:bigint,n_kmers:int>")
    def of(texts: pa.Array) -> pa.Array:
        found = [(*fingerprint(seq), len(seq)) for seq in sequences(as_strings(texts), p.k)]
        h1, h2, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32())], ["h1", "h2", "n_kmers"])

    return of


def packed(text) -> Column:
    """A text column compressed, behind its length in bytes: a fraction of the bytes of its k-mer hashes, which no codec shortens."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        codec, out = pa.Codec("zstd"), []
        for _, part in text_slices(as_strings(texts)):
            out += [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in part.cast(pa.binary()).to_pylist()]
        return pa.array(out, pa.binary())

    return pack(text)


def runs(*columns: pa.Array, limit: int = SLICE_BYTES):
    """Slices of the rows of ``columns`` of packed texts, of about ``limit`` unpacked bytes each (a single longer row: alone)."""
    ends = np.cumsum(sum(np.frombuffer(b"".join(pc.binary_slice(c, 0, 8).to_pylist()), "<i8") for c in columns))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield slice(start, stop)
        start = stop


def unpack(column: pa.Array, k: int):
    """The labelled k-mer hashes of each packed text."""
    codec = pa.Codec("zstd")
    for at in runs(column):
        texts = [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in column[at].to_pylist()]
        yield from sequences(pa.array(texts, pa.binary()).view(pa.string()), k)


def sequence_table(docs: DataFrame, wanted: DataFrame, c: Classes, p: DedupParams) -> DataFrame:
    """(node, seq): the packed text of the classes ``wanted`` (node, doc_id, h1, h2), from which ``unpack`` has their sequences.

    A document's text is read again, by its id. Only where an id has several rows is it told by the fingerprint
    which of them belongs to the class.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    one, many = split_by_id(wanted, c)
    out = texts.join(one.select("node", F.col("doc_id").alias("id")), "id").select("node", packed("text").alias("seq"))
    if many is not None:
        same = c.repeated.select(F.col("doc_id").alias("many_id"))
        found = texts.join(same, texts["id"].eqNullSafe(same["many_id"]), "left_semi").select("id", fingerprints(p)("text").alias("f"), packed("text").alias("seq"))
        found = found.select("id", F.col("f.h1").alias("h1"), F.col("f.h2").alias("h2"), "seq")
        found = found.join(many.select("node", "doc_id", "h1", "h2"), ["h1", "h2"]).where(F.col("id").eqNullSafe(F.col("doc_id")))
        out = out.union(found.groupBy("node").agg(F.min("seq").alias("seq")))
    return out


def verified(pairs: DataFrame, seqs: DataFrame, p: DedupParams) -> DataFrame:
    """The pairs (a, b) whose sequences align at the least similarity."""

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for at in runs(left, right):
            both = pa.concat_arrays([left[at], right[at]]).dictionary_encode()  # the first class of a star comes many times
            seqs, codes = list(unpack(both.dictionary, p.k)), both.indices.to_pylist()
            half = len(codes) // 2
            out += [aligned_similarity(seqs[a], seqs[b], p.similarity) >= p.similarity for a, b in zip(codes[:half], codes[half:], strict=True)]
        return pa.array(out, pa.bool_())

    left, right = seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa")), seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(near("sa", "sb")).select("a", "b")


def near_duplicates(docs: DataFrame, p: DedupParams | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, class_id (smallest doc_id of the connected near duplicates), kept (true for one
    row of each class, of that doc_id), exact_id (smallest doc_id of the equal k-mer sequences).

    Documents without words are classes of their own and kept. Rows that repeat a doc_id are compared each by its own
    text. Of rows with equal ids and equal k-mers one is kept. Rows with a null doc_id are compared like others and
    name a class only if it has no other id; then class_id is null. An empty table gives no rows.
    """
    p = p or DedupParams()
    c = classes_of(docs, p)
    return labelled_rows(c, survivors(c, components_of(docs, c, p)))


def survivors(c: Classes, components: DataFrame) -> DataFrame:
    """(node, class_id, best) of the classes that are linked: best tells the one class that its component keeps.

    That is the class of the smallest doc_id; of several classes of that id, the one of the smallest fingerprint.
    """
    linked = c.classes.select("node", "doc_id", "h1", "h2").join(components, "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h1", "h2", "node")).alias("first")
    best = linked.groupBy("component").agg(first).select("component", "first")
    return linked.join(best, "component").select("node", F.col("first.doc_id").alias("class_id"), (F.col("node") == F.col("first.node")).alias("best"))


def labelled_rows(c: Classes, found: DataFrame) -> DataFrame:
    named = c.classes.select("h1", "h2", "node", F.col("doc_id").alias("exact_id"), F.col("row").alias("first_row")).join(found.withColumn("linked", F.lit(True)), "node", "left")
    rows = c.rows.select("doc_id", "row", "h1", "h2", "n_kmers").join(named, ["h1", "h2"], "left")
    own = F.col("n_kmers") == 0
    kept = own | ((F.col("row") == F.col("first_row")) & F.coalesce("best", F.lit(True)))
    class_id = F.when(own, F.col("doc_id")).when(F.col("linked"), F.col("class_id")).otherwise(F.col("exact_id"))
    return rows.select("doc_id", class_id.alias("class_id"), kept.alias("kept"), F.when(own, F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"))


def components_of(docs: DataFrame, c: Classes, p: DedupParams) -> DataFrame:
    """(node, component) of the classes that are linked to others."""
    entries = c.classes.select("node", "n", F.posexplode("keys").alias("s", "key")).select("node", "n", F.xxhash64("s", "key").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("first"), F.min_by("n", "node").alias("first_n")).where("size > 1")
    # counts are written before they are joined back: an exchange of its own on each side lets a hot key be split
    buckets = shared_checkpoint(entries.join(shared_checkpoint(sizes), "key"))
    near = lambda x, y: F.least(x, y) >= p.similarity * F.greatest(x, y) - 1e-9  # noqa: E731  alignment can't beat the ratio of the lengths
    large = buckets.where(F.col("size") > p.small_bucket)
    star = large.where((F.col("node") != F.col("first")) & near(F.col("n"), F.col("first_n"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    small = buckets.where(F.col("size") <= p.small_bucket).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m"))
    small = small.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: y["node"] > F.col("x.node"))).alias("y"))
    small = small.where(near(F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = shared_checkpoint(star.union(small).distinct())
    compared = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    wanted = c.classes.select("node", "doc_id", "h1", "h2").join(compared, "node")
    seqs = shared_checkpoint(sequence_table(docs, wanted, c, p))
    components = linked(pairs, seqs, p)
    units = family_units(large, components, seqs, p)
    if units is None:
        return components.toDF("node", "component")
    more = compared_blocks(units, seqs, p)
    return merged(components.toDF("node", "component"), connected_components(more, "a", "b").toDF("component", "joined"))


def linked(pairs: DataFrame, seqs: DataFrame, p: DedupParams) -> DataFrame:
    """The components that the near ones of ``pairs`` (a < b) make.

    Texts are joined to one pair of each b first, then only to those pairs that still lie between two components: a
    pair inside a component can't change it, and most pairs of a large group lie there.
    """
    first = shared_checkpoint(pairs.groupBy("b").agg(F.min("a").alias("a")))
    components = shared_checkpoint(connected_components(verified(first, seqs, p), "a", "b"))
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = shared_checkpoint(verified(rest, seqs, p))
    if more.isEmpty():
        return components
    return shared_checkpoint(connected_components(components.toDF("a", "b").union(more), "a", "b"))


def merged(components: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, component) after further links between components; ``joined`` names the component that each belongs to.

    A component that held one class only is not among ``components``; then its name is that class.
    """
    joined = shared_checkpoint(joined)
    renamed = components.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    alone = joined.select(F.col("component").alias("node"), F.col("joined").alias("component")).join(components, "node", "left_anti")
    return shared_checkpoint(renamed.union(alone))


def prefix_sizes(n, p: DedupParams):
    """How many of the rarest k-mers a text of n must look up (as the longer one of a pair), and offer (as the shorter)."""
    look = n - F.ceil(n * F.lit(p.similarity) - F.lit(1e-9)) + 1
    offer = n - F.ceil(n * F.lit(2 * p.similarity / (1 + p.similarity)) - F.lit(1e-9)) + 1
    return look, offer


def family_units(large: DataFrame, components: DataFrame, seqs: DataFrame, p: DedupParams) -> DataFrame | None:
    """Blocks of the families of the classes that large buckets leave apart: (family, i, j, node, component, left);
    None if there are none."""
    named = large.select("key", "node", "n").join(components.toDF("node", "component"), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    apart = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    loose = shared_checkpoint(named.join(shared_checkpoint(apart), "key").select("node", "n", "component").distinct())
    if loose.isEmpty():
        return None

    def exploded(batches):
        for batch in batches:
            for at in runs(batch.column(2)):
                seqs = list(unpack(batch.column(2)[at], p.k))
                sizes = np.array([len(x) for x in seqs], np.int32)
                columns = [np.repeat(np.asarray(x), sizes) for x in (batch.column(0)[at], batch.column(1)[at], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.concatenate(seqs).view(np.int64))], names=["node", "component", "n", "kmer"])

    items = loose.join(seqs, "node").select("node", "component", "seq").mapInArrow(exploded, "node long, component long, n int, kmer long")
    often = items.groupBy("kmer").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high")).where("f > 1")
    # k-mers of one class only come first in the order of rarity and find nothing, so only their number counts
    shared = items.select("node", "n", "kmer").join(shared_checkpoint(often), "kmer").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "kmer", (F.col("low") < F.col("high")).alias("apart")))).alias("shared"))
    look, offer = prefix_sizes(F.col("n"), p)
    alone = F.col("n") - F.size("shared")
    prefix = shared.select("node", (offer - alone).alias("offered"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(look - alone, F.lit(0)).cast("int"))).alias("rank", "k"))
    prefix = prefix.where("k.apart").select("node", F.col("k.kmer").alias("kmer"), (F.col("rank") < F.col("offered")).alias("offers"))
    prefix = shared_checkpoint(prefix.join(loose.drop("n"), "node"))
    groups = prefix.groupBy("kmer").agg(F.min("node").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("offers").alias("offers"))
    groups = shared_checkpoint(groups.where("low <> high and offers").select("kmer", "hub"))
    families = connected_components(prefix.join(groups, "kmer").select("hub", "node"), "hub", "node").toDF("node", "family")
    members = shared_checkpoint(families.join(loose, "node").select("family", "node", "component", "n"))
    parts = members.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    parts = parts.groupBy("family").agg(F.max(F.struct("c", "n", "component")).alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    parts = shared_checkpoint(parts.where("parts > 1"))
    return None if parts.isEmpty() else blocks_of(members, parts, p)


def blocks_of(members: DataFrame, families: DataFrame, p: DedupParams) -> DataFrame:
    """Each block of a family's classes outside its main component with itself, with those after it, and with each block
    of the main component's classes: (family, i, j, node, component, left)."""
    blocks = lambda c, n: F.ceil(F.greatest(c / p.block, n / p.block_kmers)).cast("int")
    main = F.col("main")
    families = families.select("family", main["component"].alias("main"), blocks(F.col("c") - main["c"], F.col("n") - main["n"]).alias("odd"), blocks(main["c"], main["n"]).alias("even"))
    rows = members.join(families, "family").withColumn("is_odd", F.col("component") != F.col("main"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("node", F.lit(p.seed)), F.when(F.col("is_odd"), F.col("odd")).otherwise(F.col("even"))).cast("int"))
    up_to = lambda low, high: F.explode(F.sequence(low, high))
    zero, last = F.lit(0), F.col("odd") + F.col("even") - 1
    first = rows.where("is_odd").select("family", F.col("place").alias("i"), up_to(F.col("place"), last).alias("j"), "node", "component", F.lit(True).alias("left"))
    later = rows.where("is_odd and place > 0").select("family", up_to(zero, F.col("place") - 1).alias("i"), F.col("place").alias("j"), "node", "component", F.lit(False).alias("left"))
    others = rows.where("not is_odd").select("family", up_to(zero, F.col("odd") - 1).alias("i"), (F.col("odd") + F.col("place")).alias("j"), "node", "component", F.lit(False).alias("left"))
    return first.union(later).union(others)


def shared_counts(seqs: list[np.ndarray], n_left: int, columns: int = 1 << 11) -> np.ndarray:
    """Number of equal items of each of the first ``n_left`` sequences with each sequence, as products of 0/1 matrices,
    some columns at once; items of one sequence only have none."""
    _, where, counts = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    often = counts > 1
    place = np.cumsum(often) - 1
    kept = often[where]
    row, where = row[kept], place[where[kept]]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    out, total = np.zeros((n_left, len(seqs)), np.float32), int(often.sum())
    for low in range(0, total, columns):
        a, b = np.searchsorted(where, [low, low + columns])
        part = np.zeros((len(seqs), min(columns, total - low)), np.float32)
        part[row[a:b], where[a:b] - low] = 1
        out += part[:n_left] @ part.T
    return out


def compared_blocks(units: DataFrame, seqs: DataFrame, p: DedupParams) -> DataFrame:
    """Links (a, b) between components: those of a unit's left side with all others that its classes were not linked to.

    A unit holds at most two blocks of classes, whatever the size of its family. Only pairs that share enough
    k-mers to reach the similarity are aligned.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("left", "descending"), ("node", "ascending")])
        names, seqs, n_left = np.asarray(table["component"]), list(unpack(table["seq"].combine_chunks(), p.k)), int(np.sum(np.asarray(table["left"])))
        alone = table["i"][0].as_py() == table["j"][0].as_py()  # a block with itself; else its own pairs are another unit's
        out = []
        if n_left and (alone or n_left < len(seqs)):
            sizes = np.array([len(s) for s in seqs])
            enough = shared_counts(seqs, n_left) >= p.similarity / (1 + p.similarity) * (sizes[:n_left, None] + sizes[None, :]) - 1e-3
            label = np.unique(names, return_inverse=True)[1]
            for i in range(n_left):
                todo = enough[i] & (np.arange(len(seqs)) > (i if alone else n_left - 1))
                while len(open_ := np.flatnonzero(todo & (label != label[i]))):
                    j = open_[0]
                    todo[j] = False
                    if aligned_similarity(seqs[i], seqs[j], p.similarity) >= p.similarity:
                        label[label == label[j]] = label[i]
                        out.append((names[i], names[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = units.join(seqs, "node").select("family", "i", "j", "node", "component", "left", "seq")
    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, p: DedupParams | None = None) -> DataFrame:
    """``docs`` with one row of each class, that which ``near_duplicates`` keeps; all rows without words stay.

    Of rows with equal ids and equal k-mers, the first by all their columns stays.
    """
    p = p or DedupParams()
    c = classes_of(docs, p)
    found = survivors(c, components_of(docs, c, p))
    kept = labelled_rows(c, found).where("kept").select("doc_id")
    one, _ = split_by_id(kept, c)
    out = docs.join(one.select(F.col("doc_id").alias("_kept_id")), F.col("doc_id").cast("long") == F.col("_kept_id"), "left_semi")
    if c.repeated is None:
        return out
    unlinked = c.classes.select("node", "doc_id", "h1", "h2").join(found.where("not best"), "node", "left_anti").select("doc_id", "h1", "h2")
    _, many = split_by_id(unlinked, c)
    id_ = F.col("row.doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), fingerprints(p)("text").alias("f"))
    rows = rows.join(c.repeated.select(F.col("doc_id").alias("many_id")), id_.eqNullSafe(F.col("many_id")), "left_semi")
    same = id_.eqNullSafe(F.col("doc_id")) & (F.col("f.h1") == F.col("h1")) & (F.col("f.h2") == F.col("h2"))
    first = rows.where("f.n_kmers > 0").join(many, same).groupBy("doc_id", "h1", "h2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.union(rows.where("f.n_kmers = 0").select("row.*")).union(first.select("row.*"))
