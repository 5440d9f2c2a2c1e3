"""Toxicity: Levenshtein automata intersected with a lexicon trie, and windows of context around each hit.

The lexicon is learned from labelled rows: words, and word beginnings (stems, written with a final ``*``) that
occur in toxic texts and hardly ever in others. It is kept as a trie. A word is read once against all entries
at the same time: a state of the determinised intersection is a set of (trie node, edits so far), and its
transitions are computed when first met and then kept. So ``idiott`` or ``id1ot`` is found at one edit. Stems match exactly;
the words that they cover are entries beside them and found at their own edits. Entries too short for an edit are found at
one if the word holds a sign that is no letter (``sc0m``): other letters would often make another word.

Each hit is weighed by the reliability of its entry at its number of edits on the labelled sample, which starts
from less the more edits there are for the entry's length. A window of words
around it tells abuse from quotation: quotation marks and words of reporting lower the weight, address of a
person raises it. The document's features are the maximum of these weights and the logarithm of what other hits add in
the best run of ``span`` words, so a document's length has no part in them; a logistic model, fitted on the sample,
makes them a probability. A weight is itself a probability: an exact hit of an entry that is ``precision`` reliable or more
gives the document its weight at least, so one such hit decides at any length; a quoted or reported one does not.

Whole texts are read. A null or empty text has no hit. Without labels of both classes the score is the share
of label 1 (0 without labels). Of entries at equal distance the first in the lexicon is taken. Rows that repeat an id or a
whole row, and those with a null id, are scored each; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import as_strings, release_memory, text_slices, words_of
from .quality_classifier import labelled_sample

#: Words that report speech rather than use it, and words that address a person.
REPORTING = frozenset("said says wrote called calls word words term quote quoted quotes insult insults phrase".split())
ADDRESS = frozenset("you your you're youre u du ihr dich vous tu ton te usted ustedes".split())
QUOTES = "\"“”„«»‘’'`"
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


@dataclass
class ToxicityParams:
    per_class: int = 2500
    max_chars: int = 20_000
    min_stem: int = 4
    max_stem: int = 8
    support: int = 4
    share: float = 0.03
    precision: float = 0.97
    max_entries: int = 2000
    window: int = 5
    span: int = 300
    one_edit_from: int = 5
    two_edits_from: int = 9
    max_states: int = 200_000


class Lexicon:
    """Entries in a trie, read by the lazily determinised intersection with Levenshtein automata."""

    def __init__(self, entries: list[str], p: ToxicityParams):
        self.entries, self.p = sorted(set(entries)), p
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        self.budget: list[int] = [0]  # the most edits that any entry below a node allows
        for k, entry in enumerate(self.entries):
            stem = entry.endswith("*")
            word = entry[:-1] if stem else entry
            edits = 0 if stem else max(self.allowed(word), 1)
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], edits)
            self.final[node] = k
        self.reset()

    def allowed(self, word: str) -> int:
        return 2 if len(word) >= self.p.two_edits_from else 1 if len(word) >= self.p.one_edit_from else 0

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.start = self.state(self.closure({(0, 0)}))

    def __getstate__(self):
        return {"entries": self.entries, "p": self.p}

    def __setstate__(self, kept):
        self.__init__(kept["entries"], kept["p"])

    def closure(self, pairs: set) -> frozenset:
        """With entry characters that the word leaves out; only the fewest edits of each node stay."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e or e > self.budget[node]:
                continue
            best[node] = e
            if e < 2:
                todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
        return self.states[pairs]

    def step(self, at: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[at]:
            for c, child in self.children[node].items():
                if c == ch:
                    out.add((child, e))
                elif e < 2:
                    out.add((child, e + 1))
            if e < 2:
                out.add((node, e + 1))  # an extra character
        to = self.moves[at][ch] = self.state(self.closure(out))
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) with the fewest edits, then the first entry; stems match any longer word."""
        if len(self.sets) > self.p.max_states:
            self.reset()
        at, stem = self.start, None
        for k, ch in enumerate(word):
            at = self.moves[at].get(ch, -1) if ch in self.moves[at] else self.step(at, ch)
            pairs = self.sets[at]
            if not pairs:
                return stem
            if stem is None and k + 1 >= self.p.min_stem:
                for node, e in pairs:
                    if e == 0 and self.final[node] >= 0 and self.entries[self.final[node]].endswith("*"):
                        stem = (self.final[node], 0)
        if stem:
            return stem
        found = None
        for node, e in self.sets[at]:
            k = self.final[node]
            if k >= 0 and not self.entries[k].endswith("*") and (e <= self.allowed(self.entries[k]) or e == 1 and disguised(word)):
                found = min(found or (e, k), (e, k))
        return (found[1], found[0]) if found else None


def disguised(word: str) -> bool:
    """Whether a sign that is neither a letter nor a mark of one stands in the word."""
    return any(not ch.isalpha() and category(ch)[0] != "M" for ch in word)


def cores(distinct: pa.Array) -> pa.Array:
    """Lower-cased words without the signs around them."""
    return pc.replace_substring_regex(pc.utf8_lower(distinct), pattern=EDGE, replacement="")


def learn_lexicon(texts: pa.Array, y: np.ndarray, p: ToxicityParams) -> list[str]:
    """Words and stems of ``support`` toxic texts or more whose share of toxic texts is ``precision`` or more.

    A stem is the shortest beginning that passes, if at least three words share it and none of them alone
    makes up over half of its texts; so it generalises over endings that the sample lacks.
    """
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for start, part in text_slices(texts):
        distinct, codes, offsets = words_of(part)
        core = cores(distinct).to_pylist()
        for i in range(len(part)):
            (toxic if y[start + i] else clean).update({core[c] for c in set(codes[offsets[i] : offsets[i + 1]].tolist()) if core[c]})
    n_toxic, n_clean = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)

    def passes(t: float, c: float) -> bool:
        a, b = t / n_toxic, c / n_clean
        return t >= p.support and a / max(a + b, 1e-12) >= p.precision

    stems = find_stems(toxic, clean, passes, p)
    covered = lambda w: any(w[:k] in stems for k in range(p.min_stem, len(w) + 1))
    words = {w: t for w, t in toxic.items() if len(w) >= 3 and passes(t, clean[w]) and not covered(w)}
    ranked = [w for _, w in sorted([(-t, w + "*") for w, t in stems.items()] + [(-t, w) for w, t in words.items()])]
    kept = explaining(ranked, texts, y, p)
    beside = {e[:-1] for e in kept if e.endswith("*")}
    bare = [w for w in toxic if len(w) >= p.one_edit_from and passes(max(toxic[w], p.support), clean[w]) and any(w[:k] in beside for k in range(p.min_stem, len(w) + 1))]
    return (kept + sorted(bare, key=lambda w: (-toxic[w], w)))[: p.max_entries]


def find_stems(toxic: Counter, clean: Counter, passes, p: ToxicityParams) -> dict[str, int]:
    """Word beginnings of ``min_stem`` to ``max_stem`` characters that pass, the shortest first."""
    words, counts = np.array(list(toxic), dtype=object), np.array(list(toxic.values()), dtype=float)
    others, other_counts = np.array(list(clean), dtype=object), np.array(list(clean.values()), dtype=float)
    lengths, other_lengths = np.array([len(w) for w in words], dtype=int), np.array([len(w) for w in others], dtype=int)
    stems: dict[str, int] = {}
    for k in range(p.min_stem, p.max_stem + 1):
        at, other_at = np.flatnonzero(lengths > k), np.flatnonzero(other_lengths > k)
        if not len(at):
            break
        prefixes, owner, kinds = np.unique(np.array([w[:k] for w in words[at]], dtype=f"U{k}"), return_inverse=True, return_counts=True)
        total, most = np.bincount(owner, weights=counts[at]), np.zeros(len(prefixes))
        np.maximum.at(most, owner, counts[at])
        wanted = np.flatnonzero((kinds >= 3) & (total >= 3 * p.support) & (most <= 0.5 * total))
        place = {prefixes[x]: 0.0 for x in wanted}
        for w, c in zip(others[other_at], other_counts[other_at], strict=True):
            if w[:k] in place:
                place[w[:k]] += c
        for x in wanted:
            pre = str(prefixes[x])
            if passes(total[x], place[pre]) and not any(pre[:n] in stems for n in range(p.min_stem, k)):
                if all(passes(max(counts[at[y]], p.support), clean[words[at[y]]]) for y in np.flatnonzero(owner == x)):
                    stems[pre] = int(total[x])
    return stems


def explaining(ranked: list[str], texts: pa.Array, y: np.ndarray, p: ToxicityParams) -> list[str]:
    """The entries that a share of the toxic texts has, or that explain texts which those before them don't.

    Copies of one toxic text make its rare words look telling; they explain no further text and go.
    """
    plain = {w for w in ranked if not w.endswith("*")}
    stem = {w[:-1] for w in ranked if w.endswith("*")}
    lengths = sorted({len(w) for w in stem})
    rows: dict[str, set] = defaultdict(set)
    for start, part in text_slices(texts):
        distinct, codes, offsets = words_of(part)
        core = cores(distinct).to_pylist()
        of = [([w] if w in plain else []) + [w[:k] + "*" for k in lengths if w[:k] in stem] for w in core]
        for i in range(len(part)):
            if y[start + i]:
                for c in set(codes[offsets[i] : offsets[i + 1]].tolist()):
                    for entry in of[c]:
                        rows[entry].add(start + i)
    often, kept, explained = max(p.support, p.share * y.sum()), [], set()
    for entry in ranked:
        if len(rows[entry]) >= often or len(rows[entry] - explained) >= p.support:
            kept.append(entry)
            explained |= rows[entry]
    return kept[: p.max_entries]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: dict[tuple[int, int], float]  # by (entry, edits)
    beta: np.ndarray
    p: ToxicityParams
    constant: float | None = None

    def hits(self, texts: pa.Array):
        """For each text: its number of words and [(word position, word, entry, edits, context factor)]."""
        texts = as_strings(texts)
        for _, part in text_slices(texts):
            distinct, codes, offsets = words_of(part)
            core = cores(distinct)
            encoded = core.dictionary_encode()
            found = [self.lexicon.find(w) if w else None for w in encoded.dictionary.to_pylist()]
            flags = np.array([f is not None for f in found], dtype=bool)
            of = np.asarray(encoded.indices)
            marked = flags[of] if len(of) else np.zeros(0, bool)
            at = np.flatnonzero(marked[codes]) if len(codes) else np.zeros(0, np.int64)
            rows = np.searchsorted(offsets, at, side="right") - 1
            per_row: dict[int, list] = defaultdict(list)
            for pos, row in zip(at.tolist(), rows.tolist(), strict=True):
                lo, hi = max(offsets[row], pos - self.p.window), min(offsets[row + 1], pos + self.p.window + 1)
                near = [(int(k) - pos, distinct[int(codes[k])].as_py()) for k in range(lo, hi)]
                word = distinct[int(codes[pos])].as_py()
                entry, edits = found[of[codes[pos]]]
                per_row[row].append((pos - int(offsets[row]), word, entry, edits, context(word, near)))
            for row in range(len(part)):
                yield int(offsets[row + 1] - offsets[row]), per_row.get(row, [])

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(features, the largest weight of an exact hit that decides alone, at most 1) of each text."""
        out, clear = [], []
        for _, hits in self.hits(texts):
            w = np.array([self.weights[entry, edits] * f for _, _, entry, edits, f in hits])
            out.append((w.max(initial=0.0), np.log1p(min(best_run([h[0] for h in hits], w, self.p.span), 5.0)), 1.0))
            sure = [x for x, (_, _, entry, edits, _) in zip(w, hits, strict=True) if edits == 0 and self.weights[entry, 0] >= self.p.precision]
            clear.append(min(max(sure, default=0.0), 1.0))
        return np.array(out).reshape(-1, 3), np.array(clear)

    def features(self, texts: pa.Array) -> np.ndarray:
        return self.evidence(texts)[0]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, clear = self.evidence(texts)
        return np.maximum(1 / (1 + np.exp(-np.clip(x @ self.beta, -40, 40))), clear)


def best_run(at: list[int], w: np.ndarray, span: int) -> float:
    """The largest sum of the weights ``w`` at rising positions ``at`` within ``span`` words, without its largest weight."""
    at, best = np.array(at, dtype=np.int64), 0.0
    ends = np.searchsorted(at, at + span)
    for i in np.flatnonzero(ends - np.arange(len(at)) > 1):
        part = w[i : ends[i]]
        best = max(best, float(part.sum() - part.max()))
    return best


def context(word: str, near: list[tuple[int, str]]) -> float:
    """Below 1 where the words around a hit quote it, above 1 where they address a person."""
    factor = 1.0
    quoted = word[:1] in QUOTES and word.rstrip(".,;:!?")[-1:] in QUOTES
    opened = any(k < 0 and w[:1] in QUOTES and not w[1:].rstrip(".,;:!?").endswith(tuple(QUOTES)) for k, w in near)
    closed = any(k > 0 and w.rstrip(".,;:!?")[-1:] in QUOTES for k, w in near)
    plain = {w.lower().strip(".,;:!?()" + QUOTES) for k, w in near if k}
    if quoted or opened and closed:
        factor *= 0.4
    if plain & REPORTING:
        factor *= 0.5
    if plain & ADDRESS:
        factor *= 1.25
    return factor


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, each halved until the loss falls; the weights of hits stay
    at 0 or above."""
    beta = np.zeros(x.shape[1])
    pull = np.full(len(beta), ridge)
    pull[-1] = 0.1 * ridge

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * pull @ (b * b))

    now = loss(beta)
    for _ in range(100):
        prob = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (weight * (prob - y)) + pull * beta
        hess = (x * (weight * prob * (1 - prob))[:, None]).T @ x + np.diag(pull)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6:
            tried = beta - size * move
            tried[:-1] = np.maximum(tried[:-1], 0)
            if (then := loss(tried)) < now:
                break
            size /= 2
        else:
            break
        done = now - then < 1e-9 * max(1.0, now)
        beta, now = tried, then
        if done:
            break
    return beta


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray, p: ToxicityParams | None = None) -> ToxicityModel:
    p = p or ToxicityParams()
    model = ToxicityModel(Lexicon(learn_lexicon(texts, y, p), p), {}, np.zeros(3), p)
    toxic: Counter = Counter()
    every: Counter = Counter()
    for row, (_, hits) in enumerate(model.hits(texts)):
        exact = any(h[3] == 0 for h in hits)
        for key in {(h[2], h[3]) for h in hits}:
            if key[1] and exact:  # then the exact hit explains the label
                continue
            every[key] += weight[row]
            toxic[key] += weight[row] * y[row]
    for k, entry in enumerate(model.lexicon.entries):
        for edits in (0, 1, 2):
            prior = max(0.2, 0.95 - 1.5 * edits / len(entry))
            model.weights[k, edits] = float((toxic[k, edits] + 4 * prior) / (every[k, edits] + 4))
    model.beta = logistic(model.features(texts), y, weight, ridge=0.0004 * len(y) ** 0.5)
    return model


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None) -> ToxicityModel:
    p = p or ToxicityParams()
    texts, y, weight, counts = labelled_sample(docs, labels, "toxic", 5, p.per_class, p.max_chars)
    if len(set(y)) < 2:
        share = counts.get(1, 0) / max(sum(counts.values()), 1)
        return ToxicityModel(Lexicon([], p), {}, np.zeros(3), p, constant=share)
    model = fit(texts, y, weight, p)
    release_memory()
    return model
