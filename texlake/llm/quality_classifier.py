"""Quality classifier: random-indexing vectors pooled per document, then a two-layer network.

Each unit (a lower-cased word, or the shape of a word such as ``Aa`` or ``a###``) has a sparse random index
vector; its word vector is the sum of the index vectors of the units around its occurrences in the sample. A
document is the mean of its units' vectors, besides the logarithm of its number of words and the share of words
that repeat the word before. Two dense layers in numpy give a logit, a temperature fitted on
rows set aside makes it a probability.

Fitted on at most ``per_class`` labelled rows of each class, of at most ``max_chars`` characters each (slices of longer
ones, if a class has no others); scoring reads whole texts of all rows. Rows that repeat a doc_id are scored each, those
with a null doc_id too; other columns of the table are not read. A null or empty text is the zero vector and gets the score of that vector. If a
class has no rows, the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_strings, bounded_sample, fold, release_memory, segment_sums, slice_of, text_slices, words_of


@dataclass
class QualityParams:
    per_class: int = 2500
    max_chars: int = 20_000
    dims: int = 48
    nonzero: int = 4
    window: int = 2
    max_words: int = 6000
    max_shapes: int = 600
    hidden: int = 16
    epochs: int = 250
    seed: int = 20_240


def shapes_of(distinct: pa.Array) -> pa.Array:
    """Runs of letters and digits become one sign each, runs of one symbol keep up to three of it."""
    out = distinct
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}]+", "a"), (r"\p{N}+", "9"), (r"[^\x00-\x7f]", "")):
        out = pc.replace_substring_regex(out, pattern=pattern, replacement=sign)
    return pc.utf8_slice_codeunits(out, 0, 8)


def index_vectors(n: int, dims: int, nonzero: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dims), dtype=np.float32)
    for _ in range(nonzero):
        out[np.arange(n), rng.integers(0, dims, n)] += rng.choice([-1.0, 1.0], n)
    return out


def positions_in(values: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Index of each value in the vocabulary; len(vocabulary) for those outside."""
    if not len(vocabulary):
        return np.zeros(len(values), dtype=np.int64)
    return np.asarray(pc.fill_null(pc.index_in(values, value_set=vocabulary), len(vocabulary))).astype(np.int64)


@dataclass
class QualityModel:
    """``tables`` hold the unit vectors already multiplied by the first layer: pooling is linear, so the mean of
    the products is the product of the mean, and scoring gathers ``hidden`` numbers a word, not ``dims``."""

    words: pa.Array
    shapes: pa.Array
    word_table: np.ndarray
    shape_table: np.ndarray
    extra_rows: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def hidden(self, texts: pa.Array) -> np.ndarray:
        distinct, codes, offsets = words_of(texts)
        sums = np.zeros((len(offsets) - 1, len(self.b1)))
        if len(codes):
            word = positions_in(pc.utf8_lower(distinct), self.words)
            shape = positions_in(shapes_of(distinct), self.shapes)
            sums = segment_sums((self.word_table[word] + self.shape_table[shape])[codes], offsets)
        return sums / np.maximum(np.diff(offsets)[:, None], 1) + extras(codes, offsets) @ self.extra_rows + self.b1

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.constant is not None:
            return out + self.constant
        texts = as_strings(texts)
        for start, part in text_slices(texts):
            logit = np.tanh(self.hidden(part)) @ self.w2 + self.b2
            out[start : start + len(part)] = 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))
        return out


#: Bytes of text at once in training, which runs on the driver.
TRAIN_SLICE = 1 << 20


def vocabulary(texts: pa.Array, p: QualityParams) -> tuple[pa.Array, pa.Array]:
    """The most frequent lower-cased words and the most frequent shapes of the sample."""
    words: Counter = Counter()
    shapes: Counter = Counter()
    for _, part in text_slices(texts, TRAIN_SLICE):
        distinct, codes, _ = words_of(part)
        counts = np.bincount(codes, minlength=len(distinct))
        for kept, values in ((words, pc.utf8_lower(distinct)), (shapes, shapes_of(distinct))):
            encoded = values.dictionary_encode()
            sums = np.bincount(np.asarray(encoded.indices), weights=counts, minlength=len(encoded.dictionary)).astype(int)
            often = np.flatnonzero(sums > 1)
            kept.update(dict(zip(encoded.dictionary.take(pa.array(often)).to_pylist(), sums[often].tolist(), strict=True)))
    top = lambda counted, limit: [w for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:limit]]
    return pa.array(top(words, p.max_words), pa.string()), pa.array(top(shapes, p.max_shapes), pa.string())


def unit_vectors(texts: pa.Array, p: QualityParams):
    """(words, shapes, word vectors, shape vectors) by random indexing over the sample."""
    words, shapes = vocabulary(texts, p)
    nw, ns = len(words), len(shapes)
    index = index_vectors(nw + ns + 2, p.dims, p.nonzero, p.seed)
    index_word, index_shape = index[: nw + 1], index[nw + 1 :]
    index_word[nw] = 0  # words outside the vocabulary carry no context
    vw, vs = index_word * 0.5, index_shape * 0.5
    for _, part in text_slices(texts, TRAIN_SLICE):
        distinct, codes, offsets = words_of(part)
        if not len(codes):
            continue
        word, shape = positions_in(pc.utf8_lower(distinct), words)[codes], positions_in(shapes_of(distinct), shapes)[codes]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for step in range(1, p.window + 1):
            left = np.flatnonzero(row[step:] == row[:-step])
            for at, near in ((left, left + step), (left + step, left)):
                for d in range(p.dims):
                    context = index_word[word[near], d] + index_shape[shape[near], d]
                    vw[:, d] += np.bincount(word[at], weights=context, minlength=nw + 1)
                    vs[:, d] += np.bincount(shape[at], weights=context, minlength=ns + 1)
    scale = lambda v: (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return words, shapes, scale(vw), scale(vs)


def extras(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logarithm of the number of words, and the share of words equal to the word before, of each text."""
    n = np.diff(offsets)
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][n > 0]] = 0
    return np.column_stack([np.log1p(n), segment_sums(same, offsets) / np.maximum(n, 1)])


def pooled(texts: pa.Array, words, shapes, vw, vs) -> np.ndarray:
    distinct, codes, offsets = words_of(texts)
    n = np.diff(offsets)[:, None]
    if not len(codes):
        return np.zeros((len(n), vw.shape[1] + vs.shape[1] + 2))
    word = positions_in(pc.utf8_lower(distinct), words)
    shape = positions_in(shapes_of(distinct), shapes)
    parts = [segment_sums(vw[word][codes], offsets) / np.maximum(n, 1), segment_sums(vs[shape][codes], offsets) / np.maximum(n, 1)]
    return np.hstack([*parts, extras(codes, offsets)])


def fit_temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least weighted log loss, by a search over a fixed grid."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.25), np.log(8), 61)):
        z = np.clip(logit / t, -40, 40)
        best = min(best, (float(np.sum(weight * (np.logaddexp(0, z) - y * z))), float(t)))
    return best[1]


@dataclass
class QualityNetwork:
    """The network as it is trained: standardised pooled vectors, two layers, a temperature."""

    words: pa.Array
    shapes: pa.Array
    vw: np.ndarray
    vs: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    params: list
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        return np.tanh(z @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(pooled(texts, self.words, self.shapes, self.vw, self.vs)) / self.temperature))

    def folded(self) -> QualityModel:
        w1, d = self.params[0] / self.spread[:, None], self.vw.shape[1]
        tables = (self.vw @ w1[:d]).astype(np.float32), (self.vs @ w1[d : 2 * d]).astype(np.float32)
        return QualityModel(self.words, self.shapes, *tables, w1[2 * d :], self.params[1] - self.centre @ w1, self.params[2], float(self.params[3][0]), self.temperature)


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray, p: QualityParams | None = None) -> QualityModel:
    return fit_network(texts, y, weight, p).folded()


def fit_network(texts: pa.Array, y: np.ndarray, weight: np.ndarray, p: QualityParams | None = None) -> QualityNetwork:
    """Fit on sample texts; ``weight`` undoes the sampling of classes so that probabilities match the labels' shares."""
    p = p or QualityParams()
    words, shapes, vw, vs = unit_vectors(texts, p)
    x = np.vstack([pooled(part, words, shapes, vw, vs) for _, part in text_slices(as_strings(texts), TRAIN_SLICE)])
    centre, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / spread
    rng = np.random.default_rng(p.seed)
    aside = rng.random(len(y)) < 0.2
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    train = np.flatnonzero(~aside)
    w1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], p.hidden))
    params = [w1, np.zeros(p.hidden), rng.normal(0, 0.5, p.hidden), np.zeros(1)]
    moment, square, step = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params], 0
    for _ in range(p.epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 512)):
            h = np.tanh(z[at] @ params[0] + params[1])
            prob = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = weight[at] * (prob - y[at]) / weight[at].sum()
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[at].T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                params[k] = params[k] - 0.01 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    judged = aside if aside.any() else ~aside
    network = QualityNetwork(words, shapes, vw, vs, centre, spread, params)
    network.temperature = fit_temperature(network.logit(x)[judged], y[judged], weight[judged])
    return network


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, per_class: int, max_chars: int):
    """(texts, y, weight, counts) of a bounded sample of the labelled rows whose fold modulo ``mod`` is not 0.

    Texts of more than ``max_chars`` characters are left out; if a class would then have no text, a slice of each long one
    is taken.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.where(fold(F.col("doc_id"), mod) != 0)
    ids, counts = bounded_sample(marked, "y", per_class)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy("doc_id").limit(3 * per_class)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())

    def gathered(rows: DataFrame) -> pa.Table:
        return rows.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text").orderBy("doc_id", "text").limit(4 * per_class).toArrow()

    table = gathered(texts.where(F.length("text") <= max_chars))
    if len(set(table["y"].to_pylist())) < len(counts):
        table = gathered(texts.select("doc_id", slice_of(F.col("text"), F.col("doc_id"), max_chars).alias("text")))
    y = np.asarray(table["y"]).astype(float)
    weight = np.ones(len(y))
    for value in (0, 1):
        if (y == value).any():
            weight[y == value] = counts.get(value, 1) / (y == value).sum()
    return as_strings(table["text"]), y, weight / max(weight.mean(), 1e-9) if len(y) else weight, counts


def train(docs: DataFrame, labels: DataFrame, p: QualityParams | None = None) -> QualityModel:
    p = p or QualityParams()
    texts, y, weight, counts = labelled_sample(docs, labels, "quality", 5, p.per_class, p.max_chars)
    if len(set(y)) < 2:
        share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
        none = pa.array([], pa.string())
        return QualityModel(none, none, *[np.zeros((1, 1))] * 2, np.zeros((2, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, share)
    model = fit(texts, y, weight, p)
    release_memory()
    return model


def score_column(model, text: Column, spark) -> Column:
    """P(label 1) of a text column, by a model that is sent to the executors once (some MB at most, by its parameters)."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(texts), pa.float64())

    return score(text)


def classify(docs: DataFrame, model, threshold: float, mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = docs.select("doc_id", score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id", (F.coalesce(fold(F.col("doc_id"), mod), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
