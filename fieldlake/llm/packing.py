"""Best-fit packing: documents as token ids into sequences of bounded length.

Bounded-space online best-fit: a fixed number of bins is open at a time. A
bitset keyed by free space finds the open bin that a piece fills best; if none
has room, a bin opens, and beyond the fixed number the fullest closes first.
Pieces come window by window in falling length, so that within a window this is
best-fit decreasing.

Only documents that are longer than a sequence are cut, into full pieces and a
first piece that may be shorter. A full piece is a sequence by itself and is
not dealt out.

Defined results: null or empty text is the end id alone. Very long texts give
many pieces, never a dropped token. Equal rows are packed one by one. An empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .tokens import token_arrays

#: Pieces that one task packs, and the pieces that it sorts at a time.
TASK_PIECES, WINDOW = 1 << 16, 1 << 14
#: Bins that are open at a time.
OPEN_BINS = 1 << 13


class Bins:
    """Open bins by free space; place() gives (bin, offset)."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0  # bit f is set if an open bin has f places free
        self.open = self.made = 0
        self.closed: list[int] | None = None  # where given, gets the numbers of bins that are full or closed

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        room = self.bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.most_open:
                fullest = self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
                if self.closed is not None:
                    self.closed.append(fullest)
            found, free = self.made, self.size
            self.made, self.open = self.made + 1, self.open + 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
        else:
            self.open -= 1
            if self.closed is not None:
                self.closed.append(found)
        return found, self.size - free


def cut(total: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) for rows of total ids: full pieces after a first one that may be shorter."""
    pieces = np.maximum(1, -(-total // size))
    row = np.repeat(np.arange(len(total)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lead = total - (pieces - 1) * size
    start = np.where(piece == 0, 0, lead[row] + (piece - 1) * size)
    return row, piece, start, np.where(piece == 0, lead[row], size)


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch.column(0), batch.column(1)
        for at, to, found, offsets in token_arrays(batch.column(2), path):
            n = to - at
            whole = np.full(len(found) + n, end_id, dtype="<u4")
            total = np.diff(offsets) + 1
            place = np.ones(len(whole), dtype=bool)
            place[np.cumsum(total) - 1] = False
            whole[place] = found
            row, piece, start, length = cut(total, size)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            blobs = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())]).cast(pa.binary())
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.slice(at, n).take(of), ids.slice(at, n).take(of), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), blobs], names=["row", "id", "piece", "start", "length", "ids"])


def token_pieces(docs: DataFrame, scratch: Scratch, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, piece, start, length, ids (little-endian unsigned 32-bit) of every document's ids and end_id; a written table. row numbers the input's rows, with gaps, so that a null or repeated id is no matter."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return scratch.save(source.mapInArrow(lambda it: _tokenised(it, tokenizer_path, size, end_id), "row long, id long, piece int, start long, length long, ids binary"))


def _packed(batches: Iterator[pa.RecordBatch], size: int, most_open: int, window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = (TaskContext.get().partitionId() + 1) << 40
    bins = Bins(size, most_open)

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        length = table.column("length").to_numpy()
        order = np.argsort(-length, kind="stable")
        places = np.array([bins.place(x) for x in length[order].tolist()], dtype=np.int64).reshape(-1, 2)
        out = np.empty_like(places)
        out[order] = places
        return pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), table.column("piece").combine_chunks(), pa.array(out[:, 0] + base), pa.array(out[:, 1])], names=["row", "piece", "sequence_id", "offset"])

    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, window - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == window:
                yield emit(held)
                held, rows = [], 0
    if held:
        yield emit(held)


def assign(pieces: DataFrame, scratch: Scratch, size: int = 2048, most_open: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """row, piece, sequence_id, offset of each piece; a written table. The sequences' numbers are unique, with gaps.

    The order in which a task sees its pieces is fixed by a hash, so a task
    that runs again gives the same bins.
    """
    short = pieces.where(F.col("length") < size).select("row", "piece", "length")
    parts = -(-short.count() // task_pieces) or 1
    dealt = short.withColumn("h", F.xxhash64("row", "piece")).repartition(parts, "h").sortWithinPartitions("h", "row", "piece").select("row", "piece", "length")
    packed = dealt.mapInArrow(lambda it: _packed(it, size, most_open, WINDOW), "row long, piece int, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= size).select("row", "piece", F.monotonically_increasing_id().alias("k")).select("row", "piece", (-1 - F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return scratch.save(packed.union(full))


def _whole(batches: Iterator[pa.RecordBatch], size: int, most_open: int, window: int) -> Iterator[pa.RecordBatch]:
    """Packed sequences with their ids, from pieces with theirs: what _packed() does, with the contents of the open bins at hand."""
    from pyspark import TaskContext

    base = (TaskContext.get().partitionId() + 1) << 40
    bins, held, closed = Bins(size, most_open), {}, []

    def emit(numbers: list[int]) -> pa.RecordBatch:
        rows = [held.pop(n) for n in numbers]
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([base + n for n in numbers], type=pa.int64()), pa.array([sum(len(x) for _, x in r) // 4 for r in rows], type=pa.int64()), pa.array([[i for i, _ in r] for r in rows], type=kind), pa.array([b"".join(x for _, x in r) for r in rows], type=pa.binary())], names=["sequence_id", "length", "doc_ids", "ids"])

    bins.closed = closed

    def place(waiting: list[tuple]) -> None:
        for length, doc, ids in sorted(waiting, key=lambda x: -x[0]):
            held.setdefault(bins.place(length)[0], []).append((doc, ids))

    waiting: list[tuple] = []
    for batch in batches:
        waiting += zip(batch.column("length").to_pylist(), batch.column("id").to_pylist(), batch.column("ids").to_pylist())
        while len(waiting) >= window:
            place(waiting[:window])
            del waiting[:window]
            if closed:
                yield emit(closed)
                closed.clear()
    place(waiting)
    numbers = sorted(held)
    for at in range(0, len(numbers), 512):
        yield emit(numbers[at : at + 512])


def sequences(pieces: DataFrame, size: int = 2048, most_open: int = 2048, task_pieces: int = TASK_PIECES) -> DataFrame:
    """One row per sequence: sequence_id, length, doc_ids and ids, both in order. The pieces' ids are shuffled once; full pieces are not."""
    full = pieces.where(F.col("length") >= size).select((-1 - F.monotonically_increasing_id()).alias("sequence_id"), "length", F.array("id").alias("doc_ids"), "ids")
    short = pieces.where(F.col("length") < size)
    parts = -(-short.count() // task_pieces) or 1
    dealt = short.withColumn("h", F.xxhash64("row", "piece")).repartition(parts, "h").sortWithinPartitions("h", "row", "piece").select("id", "length", "ids")
    return dealt.mapInArrow(lambda it: _whole(it, size, most_open, most_open), "sequence_id long, length long, doc_ids array<long>, ids binary").union(full)
