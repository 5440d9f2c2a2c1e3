"""Chat formatting by columnar byte assembly.

A turn becomes ``<|turn|>role\\n`` + text + ``<|end|>\\n``. Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes
``<\\|`` (in roles also a line feed becomes ``\\n``), so neither can hold a control string, and undoing it restores them.

``format_turns`` assembles all turns of an Arrow batch at once: it computes the lengths of headers, contents and
footers, cumulates them to offsets, and scatters all bytes to their places in one preallocated buffer that
becomes the result's string column. It needs no shuffle. A conversation's text is its turns' pieces in order of
turn (then the piece itself). The loss mask covers the contents of assistant turns.

``digests`` reads the formatted pieces of each conversation back in order, as a stream, with running hashes:
a conversation of any length takes the memory of one batch. A null role or text counts as empty.

Turns with the same number come in the order of their formatted pieces; rows that repeat are turns each; a null turn
comes first. Rows with a null conv_id make one conversation. Other columns are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings

#: The template.
OPEN, NEWLINE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
PIECES = "conv_id long, turn long, role string, text string, piece string, loss boolean, content_start int, content_length int"


def escape(texts: pa.Array, header: bool = False) -> pa.Array:
    out = pc.replace_substring(texts, pattern="\\", replacement="\\\\")
    out = pc.replace_substring(out, pattern="<|", replacement="<\\|")
    return pc.replace_substring(out, pattern="\n", replacement="\\n") if header else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings, offsets)."""
    strings = pa.concat_arrays([strings.cast(pa.large_string())])
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2], dtype=np.uint8) if len(strings) and strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def assemble(parts: list) -> tuple[pa.Array, list[np.ndarray]]:
    """Rows that are the concatenation of the rows of ``parts`` (string arrays, or one string for all rows).

    Returns the rows and, for each part, the byte at which it starts in each row.
    """
    n = next(len(x) for x in parts if isinstance(x, pa.Array))
    sources = []
    for x in parts:
        if isinstance(x, str):
            raw = np.frombuffer(x.encode(), dtype=np.uint8)
            sources.append((raw, np.zeros(n, np.int64), np.full(n, len(raw), np.int64)))
        else:
            data, ends = bytes_of(x)
            sources.append((data, ends[:-1], np.diff(ends)))
    lengths = np.column_stack([s[2] for s in sources]) if n else np.zeros((0, len(parts)), np.int64)
    inside = np.cumsum(lengths, axis=1) - lengths
    ends = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    for j, (data, starts, sizes) in enumerate(sources):
        total = int(sizes.sum())
        if not total:
            continue
        # scatter: the k-th byte of a row's part goes to the part's place in the row plus k
        k = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(ends[:-1] + inside[:, j], sizes) + k] = data[np.repeat(starts, sizes) + k]
    rows = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out))
    return rows, [inside[:, j] for j in range(len(parts))]


def format_batch(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, whether the content is under the loss mask, first character of the content, its characters)."""
    header, content = escape(as_strings(role), header=True), escape(as_strings(text))
    pieces, _ = assemble([OPEN, header, NEWLINE, content, CLOSE])
    start = np.asarray(pc.utf8_length(header)) + len(OPEN) + len(NEWLINE)
    return pieces, np.asarray(pc.equal(as_strings(role), TRAINED_ROLE)), start, np.asarray(pc.utf8_length(content))


def format_turns(turns: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Each turn with its formatted piece, whether its content is under the loss mask, and where that lies in the piece."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("piece", pa.string()), ("loss", pa.bool_()), ("content_start", pa.int32()), ("content_length", pa.int32())])

    def of(batches):
        for whole in batches:
            step = max(1, int(block_bytes / max(1, whole.nbytes) * whole.num_rows))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                pieces, loss, start, length = format_batch(batch.column(2), batch.column(3))
                arrays = [*batch.columns, pieces.cast(pa.string()), pa.array(loss, pa.bool_()), pa.array(start, pa.int32()), pa.array(length, pa.int32())]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(of, PIECES)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and the formatted text of each conversation: for conversations that fit a row (Spark's limit is 2 GB)."""
    pieces = format_turns(turns)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return pieces.groupBy("conv_id").agg(ordered.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"))


class Running:
    """Hashes and counts of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss: bool, start: int, length: int) -> None:
        """A formatted piece; role and text are taken from it, not from the input's columns."""
        head, _, rest = piece.partition(NEWLINE)
        role, text = unescape(head[len(OPEN) :]), unescape(rest[: -len(CLOSE)])
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode())
        if loss:
            masked = unescape(piece[start : start + length])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted pieces.

    A digest is of one string in order, so the turns of a conversation meet in one task, sorted (which
    spills to disk) and streamed; only a batch of them is in memory. A null conv_id is a conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def of(batches):
        open_: Running | None = None
        for batch in batches:
            done = []
            for conv, *piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if open_ is None or open_.conv_id != conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = Running(conv)
                open_.add(*piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(open_.row(), schema, strict=True)], schema=schema)

    pieces = format_turns(turns).select("conv_id", "turn", "piece", "loss", "content_start", "content_length")
    pieces = pieces.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "piece")
    return pieces.drop("turn").mapInArrow(of, DIGESTS)
