"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word's subwords are the byte n-grams (1 to 4) of the lower-cased word between boundary signs. A document is
the mean of the embeddings of all its subwords; embeddings and softmax are trained by stochastic gradient
descent in numpy, one document a step. A temperature fitted on rows set aside calibrates the probabilities,
and ``reject_below`` is the least calibrated probability at which a set share of the accepted rows aside is
right; ``predict`` answers ``und`` below it when asked to reject.

Fitted on at most ``per_class`` documents of each language (fewer, if all of them would be more than ``max_rows``), on
slices of ``max_chars`` characters of longer ones, and on the ``max_classes`` most frequent languages at most; prediction
reads whole texts. A text that is null or holds no letter is ``und`` with score 0. Without any training row
all texts are ``und``. Of equally probable languages the first by name is taken. Rows that repeat an id or a whole row, and
those with a null id, are judged each. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_strings, bounded_sample, fold, mix64, release_memory, segment_sums, slice_of, text_slices, words_of

UNKNOWN = "und"


@dataclass
class LangParams:
    per_class: int = 700
    max_chars: int = 8_000
    max_rows: int = 45_000  # of all languages together
    max_classes: int = 4_000
    buckets: int = 1 << 16
    dims: int = 12
    orders: tuple = (1, 2, 3, 4)
    epochs: int = 4
    rate: float = 0.5
    target_precision: float = 0.995
    seed: int = 7


def subwords(distinct: pa.Array, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, first subword of each word) of words' letters; words without letters have none."""
    core = pc.replace_substring_regex(pc.utf8_lower(distinct), pattern=r"[^\p{L}]+", replacement="")
    has = np.asarray(pc.binary_length(core)) > 0
    marked = pc.binary_join_element_wise("<", core, ">", "")
    marked = pa.concat_arrays([marked.cast(pa.large_binary())])
    ends = np.frombuffer(marked.buffers()[1], dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], dtype=np.uint8).astype(np.uint64) if len(marked) and ends[-1] else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(marked)), np.diff(ends))
    room = ends[1:][word] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    rolling, found, owner = np.zeros(len(data), dtype=np.uint64), [], []
    for n in range(1, max(p.orders) + 1):
        shifted = np.concatenate([data[n - 1 :], np.zeros(min(n - 1, len(data)), np.uint64)])
        rolling = rolling * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        if n in p.orders:
            at = np.flatnonzero((room >= n) & has[word]) if len(data) else np.zeros(0, np.int64)
            found.append((mix64(rolling[at] + np.uint64(n)) % np.uint64(p.buckets)).astype(np.int64))
            owner.append(word[at])
    buckets, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(distinct)))])


@dataclass
class LangModel:
    """``table`` and ``out``: the embeddings of the buckets and the softmax weights. With no more languages than dimensions
    the table is multiplied by the weights beforehand (averaging is linear), and ``out`` is None."""

    langs: list[str]
    table: np.ndarray
    out: np.ndarray | None
    bias: np.ndarray
    temperature: float
    reject_below: float
    p: LangParams

    def folded(self) -> LangModel:
        if self.out is None or self.out.shape[1] > self.out.shape[0]:
            return self
        return replace(self, table=(self.table @ self.out).astype(np.float32), out=None)

    def word_sums(self, distinct: pa.Array, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the rows of each word's subwords, and their number; some words at once, to bound memory."""
        sums, sizes = np.zeros((len(distinct), self.table.shape[1]), np.float32), np.zeros(len(distinct), np.int32)
        for at in range(0, len(distinct), step):
            buckets, first = subwords(distinct.slice(at, step), self.p)
            sums[at : at + step] = segment_sums(self.table[buckets], first)
            sizes[at : at + step] = np.diff(first)
        return sums, sizes

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, whether the text has a letter)."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool)
        texts = as_strings(texts)
        for start, part in text_slices(texts, SLICE_BYTES):
            distinct, codes, offsets = words_of(part)
            sums, sizes = self.word_sums(distinct)
            n = segment_sums(sizes[codes].astype(float), offsets)
            logit = segment_sums(sums[codes], offsets) / np.maximum(n, 1)[:, None]
            logit = (logit if self.out is None else logit @ self.out) + self.bias
            z = logit / self.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            at = slice(start, start + len(part))
            out[at], letters[at] = z / z.sum(axis=1, keepdims=True), n > 0
        return out, letters

    def predict(self, texts: pa.Array, reject: bool = False) -> tuple[list, np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        prob, letters = self.probabilities(texts)
        best = prob.argmax(axis=1)
        score = np.where(letters, prob[np.arange(len(best)), best], 0.0)
        known = letters & (score >= (self.reject_below if reject else 0))
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def document_features(texts: pa.Array, p: LangParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: its distinct buckets and their shares of all its subwords."""
    out = []
    for _, part in text_slices(texts, 1 << 20):
        distinct, codes, offsets = words_of(part)
        buckets, first = subwords(distinct, p)
        for i in range(len(part)):
            words, times = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)
            sizes = first[words + 1] - first[words] if len(words) else np.zeros(0, np.int64)
            start = np.repeat(first[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(words) else sizes
            ids = buckets[start + np.arange(sizes.sum())] if len(words) else sizes
            kinds, inverse = np.unique(ids, return_inverse=True)
            share = np.bincount(inverse, weights=np.repeat(times, sizes), minlength=len(kinds)) if len(kinds) else np.zeros(0)
            out.append((kinds, share / max(share.sum(), 1)))
    return out


def fit(texts: pa.Array, langs: list[str], p: LangParams | None = None) -> LangModel:
    p = p or LangParams()
    names = sorted(set(langs))
    if not names:
        return LangModel([], np.zeros((p.buckets, 0)), None, np.zeros(0), 1.0, 0.0, p)
    y = np.array([names.index(x) for x in langs])
    features = document_features(as_strings(texts), p)
    rng = np.random.default_rng(p.seed)
    aside = rng.random(len(y)) < 0.15
    usable = np.array([len(ids) > 0 for ids, _ in features])
    train = np.flatnonzero(~aside & usable)
    emb = rng.normal(0, 0.1, (p.buckets, p.dims))
    out, bias = rng.normal(0, 0.3, (p.dims, len(names))), np.zeros(len(names))
    step, steps = 0, max(1, p.epochs * len(train))
    for _ in range(p.epochs):
        for i in rng.permutation(train):
            ids, share = features[i]
            rate = p.rate * (1 - step / steps)
            step += 1
            rows = emb[ids]
            mean = share @ rows
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * g
            # the shares of a document sum to 1 over thousands of buckets: the rate of a bucket grows with their number
            emb[ids] = rows - rate * np.outer(share * min(len(ids), 500), back)
    direct = LangModel(names, emb.astype(np.float32), out, bias, 1.0, 0.0, p)
    model = direct.folded()
    judged = np.flatnonzero(aside & usable) if (aside & usable).sum() >= 20 else train
    if len(judged) and len(names) > 1:
        logit = np.stack([features[i][1] @ emb[features[i][0]] @ out + bias for i in judged])
        best = (np.inf, 1.0)
        for t in np.exp(np.linspace(np.log(0.2), np.log(8), 61)):
            z = logit / t
            z = z - z.max(axis=1, keepdims=True)
            best = min(best, (float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(judged)), y[judged]]).mean()), float(t)))
        model.temperature = best[1]
        z = np.exp(logit / best[1] - (logit / best[1]).max(axis=1, keepdims=True))
        prob = z / z.sum(axis=1, keepdims=True)
        sure, right = prob.max(axis=1), prob.argmax(axis=1) == y[judged]
        order = np.argsort(-sure)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= p.target_precision)
        model.reject_below = float(sure[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, mod: int = 4, held_out: int = 2, p: LangParams | None = None) -> LangModel:
    """Learn from text and non-null lang of the documents whose fold is not ``held_out``.

    Every language is learned, up to the ``max_classes`` most frequent: on about ``per_class`` rows each, on fewer if that
    would be more than ``max_rows`` in all. Of a text longer than ``max_chars`` a slice is learned from.
    """
    p = p or LangParams()
    seen = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    seen = seen.where((fold(F.col("doc_id"), mod) != held_out) & (F.length("text") > 0))
    ids, _ = bounded_sample(seen, "lang", p.per_class, p.max_classes, p.max_rows)
    rows = ids.select("doc_id", "lang", slice_of(F.col("text"), F.col("doc_id"), p.max_chars).alias("text"))
    table = rows.orderBy("doc_id", "lang", "text").limit(2 * p.max_rows).toArrow()
    model = fit(as_strings(table["text"]), table["lang"].to_pylist(), p)
    release_memory()
    return model


def identify(docs: DataFrame, model: LangModel, mod: int = 4, held_out: int = 2, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        langs, score = sent.value.predict(texts, reject)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], fields=list(kind))

    out = docs.select("doc_id", judge(F.col("text")).alias("found"))
    return out.select(
        "doc_id", (F.coalesce(fold(F.col("doc_id"), mod), F.lit(-1)) == held_out).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
