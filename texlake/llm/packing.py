"""Packing documents into windows of tokens by non-negative least squares.

A document is its token ids and one end id. Whole windows are cut off its front; what remains is shorter than a
window. For the remainders of a block of documents, combinations of two and three lengths that fill a window
exactly are enumerated, and non-negative least squares gives the repeat counts that come nearest to the
histogram of lengths. The counts are rounded, dealt to documents while they last, and dealt greedily again to
combinations that still fit, so these documents lie whole in full windows. Residual documents are packed one
after another, the one that crosses a window's end being cut there. A window that stays open is carried to the
next block; a task's last one is cut into windows whose lengths are powers of two, which need no padding.

A task packs its own documents, block by block, so there is no shuffle, memory is that of a block
(``block_tokens``) whatever the partition, and a task that is run again gives a complete result of its own.
Sequence ids hold the partition's number, so they are unique. A null or empty text is its end id alone.

Rows are packed in the order in which a task reads them. Each row is a document, also one that repeats a doc_id or a whole
row, and one whose doc_id is null (its pieces then have a null doc_id and are told apart by their places). Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_strings, text_slices

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class PackParams:
    window: int = 2048
    end_id: int = 1
    block_tokens: int = 3_000_000
    common_lengths: int = 256
    max_combinations: int = 3000
    iterations: int = 120


#: Fixed value: how a byte-level tokenizer splits a text before it merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between white space (or at the end): there the split depends on more than the words beside it.
WIDE = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}] (?:[\x09-\x0d\x1c-\x20\x{85}\p{Z}]|$)"
#: Words that begin and end with other signs than white space.
INNER = r"^[^\x09-\x0d\x1c-\x20\x{85}\p{Z}](?:[\x{0}-\x{10FFFF}]*[^\x09-\x0d\x1c-\x20\x{85}\p{Z}])?$"
PROBE = "The 3 words,  it's\n\n here: 'Straße' naïve \u2026 \U0001f600 x_1!!\t(end)\u00a0 10%"


def byte_signs() -> dict[str, int]:
    """The signs by which a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    signs |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return signs


def in_order(model: dict) -> bool:
    """Whether the merges come in the order of the ids that they make."""
    pairs = (x.split(" ") if isinstance(x, str) else x for x in model.get("merges", []))
    made = [model["vocab"]["".join(pair)] for pair in pairs]
    return all(a < b for a, b in zip(made, made[1:], strict=False))


class WordTokenizer:
    """Ids of whole texts by a byte-level BPE tokenizer file, each distinct word being encoded once.

    Such a tokenizer splits a text in front of every single space that stands between words, and its merges do
    not cross splits; so a text's ids are those of the pieces between its spaces. Texts with a space beside
    other white space, or with a special token, are encoded as a whole. Words are merged by a second
    library from the same file's vocabulary: it merges in the order of ids, so the file's merges must come in that
    order, and it must give the same ids as ``tokenizers`` on a probe that holds every 16th word of the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merger = Tokenizer.from_file(path), None
        kept = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in kept.get("added_tokens", [])]
        signs = byte_signs()
        vocabulary = {w: i for w, i in kept["model"]["vocab"].items() if w not in self.special}
        if kept["model"]["type"] == "BPE" and all(ch in signs for w in vocabulary for ch in w):
            import tiktoken

            ranks = {bytes(signs[ch] for ch in w): i for w, i in vocabulary.items()}
            merger = tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            probe = PROBE + " ".join(raw.decode(errors="ignore") for raw in list(ranks)[::16])
            if in_order(kept["model"]) and merger.encode_ordinary(probe) == self.tokenizer.encode(probe, add_special_tokens=False).ids:
                self.merger = merger
                self.byte_length = np.zeros(max(ranks.values()) + 1, np.int64)
                for raw, i in ranks.items():
                    self.byte_length[i] = len(raw)

    def encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if self.merger is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        else:
            ids = [self.merger.encode_ordinary(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def encode_spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_each``, of words with a space before each: in one run, cut by the bytes of the ids."""
        if self.merger is None or not len(words):
            return self.encode_each([" " + w for w in words.to_pylist()])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = self.merger.encode_to_numpy(" " + joined, disallowed_special=())
        ends = np.cumsum(np.asarray(pc.binary_length(words)).astype(np.int64) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.byte_length[ids]), ends, side="right"), prepend=0)

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded as a whole."""
        out = np.asarray(pc.match_substring_regex(texts, WIDE))
        for token in self.special:
            out = out | np.asarray(pc.match_substring(texts, token))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text, with one more entry than there are texts)."""
        texts = as_strings(texts)
        odd = self.whole(texts)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        parts = pc.split_pattern(plain, " ")
        sizes = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        encoded = parts.flatten().dictionary_encode()
        codes, distinct = np.asarray(encoded.indices), encoded.dictionary
        # the distinct words are encoded in three groups: after a space in one run, after a space alone, first in a text
        joint = np.asarray(pc.match_substring_regex(distinct, INNER))
        head_at = np.cumsum(sizes) - sizes
        heads = np.unique(codes[head_at])
        runs, apart = np.flatnonzero(joint), np.flatnonzero(~joint)
        groups = [
            self.encode_spaced(distinct.take(pa.array(runs))),
            self.encode_each([" " + w for w in distinct.take(pa.array(apart)).to_pylist()]),
            self.encode_each(distinct.take(pa.array(heads)).to_pylist()),
        ]
        flat, count = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
        begin = np.cumsum(count) - count
        place, bare = np.zeros(len(distinct), np.int32), np.zeros(len(distinct), np.int32)
        place[runs], place[apart] = np.arange(len(runs)), len(runs) + np.arange(len(apart))
        bare[heads] = len(distinct) + np.arange(len(heads))
        slot = place[codes]
        slot[head_at] = bare[codes[head_at]]
        count, begin = count[slot], begin[slot]
        word_ends = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(begin - word_ends[:-1], count) + np.arange(word_ends[-1])]
        offsets = word_ends[np.concatenate([[0], np.cumsum(sizes)])]
        if odd.any():
            at = np.flatnonzero(odd).tolist()
            found = self.tokenizer.encode_batch_fast([texts[i].as_py() for i in at], add_special_tokens=False)
            by_row = {i: np.array(e.ids, np.uint32) for i, e in zip(at, found, strict=True)}
            rows = [by_row[i] if i in by_row else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            ids, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, offsets


def combinations(histogram: np.ndarray, p: PackParams) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window and whose lengths occur."""
    present = np.flatnonzero(histogram)
    pairs = present[(present * 2 <= p.window)]
    pairs = pairs[histogram[p.window - pairs] > 0] if len(pairs) else pairs
    out = [np.column_stack([pairs, p.window - pairs, np.zeros_like(pairs)])]
    often = np.sort(present[np.argsort(-histogram[present], kind="stable")[: p.common_lengths]])
    a, b = np.meshgrid(often, often, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    c = p.window - a - b
    ok = (c >= b) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = histogram[c] > 0
    triples = np.column_stack([a[ok], b[ok], c[ok]])
    worth = histogram[triples].min(axis=1) if len(triples) else np.zeros(0)
    out.append(triples[np.argsort(-worth, kind="stable")[: p.max_combinations]])
    return np.concatenate(out).astype(np.int64)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, iterations: int) -> np.ndarray:
    """x >= 0 with the least squared difference between the lengths that x repeats use and the histogram.

    Multiplicative updates; all entries are non-negative, so each step lowers the difference and keeps x >= 0.
    """
    used = combos > 0
    h = histogram.astype(float)
    take = lambda v: (v[combos] * used).sum(axis=1)
    towards = take(h)
    x = np.full(len(combos), h.sum() / max(1, len(combos)) / 3)
    flat, mask = combos.ravel(), used.ravel()
    for _ in range(iterations):
        load = np.bincount(flat[mask], weights=np.repeat(x, combos.shape[1])[mask], minlength=len(h))
        x = x * towards / np.maximum(take(load), 1e-9)
    return x


def repeats(histogram: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, whole repeat counts that the histogram can pay)."""
    combos = combinations(histogram, p)
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    x = np.rint(solve_counts(combos, histogram, p.iterations)).astype(np.int64)
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for bound in (x, None):  # as solved, then greedily what still fits
        for k in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
            n = int((left[lengths] // times).min())
            n = n if bound is None else min(n, int(bound[k]))
            if n > 0:
                counts[k] += n
                left[lengths] -= n * times
    return combos, counts


@dataclass
class Packer:
    """State of one task: the pieces of the open window, and the number of the next sequence."""

    p: PackParams
    first_sequence: int
    open: list = field(default_factory=list)  # (doc, start, length) with doc = (doc_id, ids)
    sequences: int = 0

    def next_sequence(self) -> int:
        self.sequences += 1
        return self.first_sequence + self.sequences - 1

    def block(self, docs: list[tuple]) -> list[tuple]:
        """(doc, start, length, sequence, offset) of the pieces of ``docs``; the open window is kept back."""
        w, out = self.p.window, []
        by_length: dict[int, list] = {}
        for doc in docs:
            n = len(doc[1])
            whole = n // w
            out += [(doc, k * w, w, self.next_sequence(), 0) for k in range(whole)]
            if n % w:
                by_length.setdefault(n % w, []).append((doc, whole * w, n % w))
        histogram = np.zeros(w + 1, np.int64)
        for length, pieces in by_length.items():
            histogram[length] = len(pieces)
        for combo, times in zip(*repeats(histogram, self.p), strict=True):
            for _ in range(times):
                sequence, offset = self.next_sequence(), 0
                for length in combo[combo > 0].tolist():
                    out.append((*by_length[length].pop(), sequence, offset))
                    offset += length
        residual = [x for length in sorted(by_length, reverse=True) for x in by_length[length]]
        return out + self.fill(residual)

    def fill(self, pieces: list[tuple]) -> list[tuple]:
        """Pack pieces behind those of the open window, cutting at the ends of windows."""
        out, room = [], self.p.window - sum(x[2] for x in self.open)
        for doc, start, length in pieces:
            while length:
                part = min(room, length)
                self.open.append((doc, start, part))
                start, length, room = start + part, length - part, room - part
                if not room:
                    out += self.close(self.open)
                    self.open, room = [], self.p.window
        return out

    def close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, offset, out = self.next_sequence(), 0, []
        for doc, start, length in pieces:
            out.append((doc, start, length, sequence, offset))
            offset += length
        return out

    def finish(self) -> list[tuple]:
        """The last open window, cut at powers of two."""
        out, todo = [], list(reversed(self.open))
        rest = sum(x[2] for x in todo)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            room, part = size, []
            while room:
                doc, start, length = todo.pop()
                n = min(room, length)
                part.append((doc, start, n))
                if n < length:
                    todo.append((doc, start + n, length - n))
                room -= n
            out += self.close(part)
            rest -= size
        self.open = []
        return out


def record(pieces: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [
        [x[0][0] for x in pieces], [x[1] for x in pieces], [x[2] for x in pieces], [len(x[0][1]) for x in pieces], [x[3] for x in pieces], [x[4] for x in pieces],
        [x[0][1][x[1] : x[1] + x[2]].astype("<u4").tobytes() for x in pieces],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, p: PackParams | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    p = p or PackParams()
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])

    def of(batches):
        tokenizer = WordTokenizer(tokenizer_path)
        packer = Packer(p, TaskContext.get().partitionId() << 36)
        block, tokens = [], 0
        for batch in batches:
            for at, part in text_slices(as_strings(batch.column(1)), SLICE_BYTES):
                ids, offsets = tokenizer.encode(part)
                names = batch.column(0).slice(at, len(part)).to_pylist()
                ids, small = ids.astype(np.uint32), len(names)
                # one array with the end ids put in, so that a document is a view of it
                whole = np.insert(ids, offsets[1:], p.end_id).astype(np.uint32)
                ends = offsets[1:] + np.arange(1, small + 1)
                begins = np.concatenate([[0], ends[:-1]])
                block += [(name, whole[b:e]) for name, b, e in zip(names, begins.tolist(), ends.tolist(), strict=True)]
                tokens += len(whole)
                if tokens >= p.block_tokens:
                    yield record(packer.block(block), schema)
                    block, tokens = [], 0
        last = packer.block(block) + packer.finish()
        if last:
            yield record(last, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, PIECES)
