"""Suffix-array dedup: remove every byte of a string of `length` bytes that starts anywhere else too.

All texts as one suffix array would need a shuffle of every suffix. Instead,
strings are dealt to shards by content: each string of `length` bytes has one
anchor, the place of the smallest hash among its k-grams, so that equal strings
have equal anchors at equal distances. A text's strings with the same anchor
stand next to each other and form a segment. An anchor's hash that occurs once
in the corpus has no repeated string; those that occur in several segments meet
in one shard, where induced sorting builds the suffix array of the segments and
permuted common prefixes show which strings repeat.

Segments with equal bytes are one row with a count before they are dealt: their
strings repeat as they are. So no group of copies lands in one task. An anchor
hash with very many different segments (a passage that many texts share, with
other surroundings in each) is split: its strings go by their own hash to a
number of ranges that grows with their number.

Defined results: null text is the empty text. A text shorter than `length` is
kept whole. Very long texts and single runs of one byte give many segments of
few classes. Equal rows count as each other's copies, whatever their ids; rows
are told apart by their row keys, so that ids may be null or repeated. An empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import ROW, Scratch, numbered
from .suffix_array import SEPARATOR, repeated


@dataclass(frozen=True)
class Repeats:
    """Parameters: bytes of a string, of an anchor's k-gram; bytes of a suffix array, about (a task makes two or so, one after the other); bytes of an anchor's segments from which it is split; strings of a range."""

    length: int = 400
    gram: int = 24
    shard_bytes: int = 2 << 20
    hot_bytes: int = 2 << 20
    range_strings: int = 1 << 20


def segments(data: np.ndarray, offsets: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """(row, first string's start in the row, number of strings, anchor hash, content hash) of a slice's segments."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n, grams = len(data), p.length - p.gram + 1  # k-grams of a string
    if n < p.length:
        return empty
    prefix = T.prefix_hash(T.BYTE_CODES[data])
    at = np.arange(n - p.gram + 1)
    h = T.range_hash(prefix, at, at + p.gram)
    # The least (hash, place) of each string's k-grams: the suffix least of one block against the prefix least of the next.
    key = (h & ~T.U((1 << 24) - 1)) | (at.astype(np.uint64) & T.U((1 << 24) - 1)) if n < 1 << 24 else None
    if key is None:
        raise ValueError("a text of 16 MB or more must come in several slices")
    pad = -len(key) % grams
    blocks = np.append(key, np.full(pad, ~T.U(0))).reshape(-1, grams)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - p.length + 1)
    anchor = (np.minimum(behind[start], ahead[start + grams - 1]) & T.U((1 << 24) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, start, side="right") - 1
    good = start + p.length <= offsets[row + 1]
    start, anchor, row = start[good], anchor[good], row[good]
    if not len(start):
        return empty
    lead = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    first, count = start[lead], np.diff(np.append(lead, len(start)))
    a = anchor[lead]
    content = T.range_hash(prefix, first, first + count - 1 + p.length) + (a - first).astype(np.uint64) * T.MULTIPLIERS[5]
    return row[lead], first - offsets[row[lead]], count, h[a], T.mix(content)


#: Bytes of a slice; places inside a slice have 24 bits. A longer text is cut into slices that share length - 1 bytes.
SLICE = 2 << 20


def _slices(texts: pa.Array, p: Repeats) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes of the row before this slice, bytes, offsets)."""
    for at, to, data, offsets in T.pieces(texts, SLICE):
        if len(data) <= SLICE or to - at > 1:
            yield at, to, 0, data, offsets
            continue
        for base in range(0, len(data) - p.length + 1, SLICE - p.length + 1):
            part = data[base : base + SLICE]
            yield at, to, base, part, np.array([0, len(part)])


def _segments(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, base, data, offsets in _slices(batch.column(1), p):
            row, low, count, anchor, content = segments(data, offsets, p)
            ids = batch.column(0).slice(at, to - at).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(low + base), pa.array(count), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], names=["row", "low", "n", "k", "c"])


def _cut_out(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    """Segments' bytes of each text."""
    for batch in batches:
        for k in range(batch.num_rows):
            text, parts = batch.column(0)[k].as_buffer(), batch.column(1)[k].values
            data = np.frombuffer(text, dtype=np.uint8) if text.size else np.zeros(0, dtype=np.uint8)
            low, n = parts.field("low").to_numpy(), parts.field("n").to_numpy()
            blobs = [data[i : i + m - 1 + p.length].tobytes() for i, m in zip(low.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([parts.field("k"), parts.field("c"), parts.field("hot"), pa.array(blobs, type=pa.binary())], names=["k", "c", "hot", "blob"])


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, after) of each run of marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _shard(batches: Iterator[pa.RecordBatch], p: Repeats) -> Iterator[pa.RecordBatch]:
    """(k, c, low, high): repeated strings of a segment class, as runs of starts inside it. One suffix array for each shard_bytes or so of whole anchor groups, which come sorted by k."""

    def solve(ks: list[int], cs: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        size = np.array([len(b) for b in blobs], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        s = np.full(int((size + 1).sum()), SEPARATOR, dtype=np.int16)
        inside = np.ones(len(s), dtype=bool)
        inside[start + size] = False
        s[inside] = np.frombuffer(b"".join(blobs), dtype=np.uint8).astype(np.int16) + 1
        first, after = _runs(repeated(s, p.length))
        # A run of starts ends where its segment's strings end, at a separator at the latest.
        of = np.searchsorted(start, first, side="right") - 1
        low = first - start[of]
        return pa.RecordBatch.from_arrays([pa.array(np.array(ks, dtype=np.int64)[of]), pa.array(np.array(cs, dtype=np.int64)[of]), pa.array(low), pa.array(low + after - first)], names=["k", "c", "low", "high"])

    ks, cs, blobs, held = [], [], [], 0
    for batch in batches:
        for k, c, blob in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist(), batch.column("blob").to_pylist()):
            if held > p.shard_bytes and k != ks[-1]:
                yield solve(ks, cs, blobs)
                ks, cs, blobs, held = [], [], [], 0
            ks.append(k)
            cs.append(c)
            blobs.append(blob)
            held += len(blob)
    if blobs:
        yield solve(ks, cs, blobs)


def _dealt(batches: Iterator[pa.RecordBatch], ranges: int, p: Repeats) -> Iterator[pa.RecordBatch]:
    """A split anchor's segments as string hashes, one row for each segment and range."""
    for batch in batches:
        for k, c, blob in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist(), batch.column("blob").to_pylist()):
            data = np.frombuffer(blob, dtype=np.uint8)
            at = np.arange(len(data) - p.length + 1)
            h = T.range_hash(T.prefix_hash(T.BYTE_CODES[data]), at, at + p.length)
            part = (h >> T.U(33)) % T.U(ranges)
            rows = [(int(r), h[part == r].tobytes(), at[part == r].astype(np.int32).tobytes()) for r in np.unique(part)]
            parts, hashes, places = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(parts, type=pa.int32()), pa.array([k] * len(rows)), pa.array([c] * len(rows)), pa.array(hashes, type=pa.binary()), pa.array(places, type=pa.binary())], names=["part", "k", "c", "hashes", "places"])


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, c, low, high) of repeated strings in one range of hashes; equal strings have equal anchors, so that the hash alone decides."""
    tables = list(batches)
    if not sum(b.num_rows for b in tables):
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), dtype=np.uint64)
    places = np.frombuffer(b"".join(t.column("places").to_pylist()), dtype=np.int32).astype(np.int64)
    row = np.repeat(np.arange(t.num_rows), [len(x) // 8 for x in t.column("hashes").to_pylist()])
    part = np.repeat(t.column("part").to_numpy(), [len(x) // 8 for x in t.column("hashes").to_pylist()])
    order = np.lexsort((h, part))
    h, part = h[order], part[order]
    same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
    hit = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    k, c = t.column("k").to_numpy()[row[hit]], t.column("c").to_numpy()[row[hit]]
    # Runs of neighbouring strings of a segment are one row.
    order = np.lexsort((places[hit], row[hit]))
    k, c, at, r = k[order], c[order], places[hit][order], row[hit][order]
    if len(at):
        lead = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(lead[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(k[lead]), pa.array(c[lead]), pa.array(at[lead]), pa.array(at[last] + 1)], names=["k", "c", "low", "high"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, spans, kept) from a text and its runs of removed bytes."""
    for batch in batches:
        ids, n_bytes, spans, kept = batch.column(0), [], [], []
        for k in range(batch.num_rows):
            data = np.frombuffer(batch.column(1)[k].as_buffer(), dtype=np.uint8) if batch.column(1)[k].as_buffer().size else np.zeros(0, dtype=np.uint8)
            found = batch.column(2)[k].values
            change = np.zeros(len(data) + 1, dtype=np.int64)
            if found is not None and len(found):
                np.add.at(change, found.field("start").to_numpy(), 1)
                np.add.at(change, found.field("stop").to_numpy(), -1)
            gone = np.cumsum(change[:-1]) > 0
            first, after = _runs(gone)
            n_bytes.append(len(data))
            spans.append([{"start": int(i), "stop": int(j)} for i, j in zip(first, after)])
            kept.append(data[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, type=pa.int64()), pa.array(spans, type=kind), pa.array(kept, type=pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Repeats | None = None) -> DataFrame:
    """Per document: id, n_bytes, spans (removed runs of bytes, as start and stop), kept (the remaining bytes, which may begin or end inside a character)."""
    p = params or Repeats()
    scratch = Scratch(docs.sparkSession, "repeats")
    source = numbered(docs, scratch).select("row", F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.expr("cast('' as binary)")).alias("data"))
    found = scratch.save(source.select("row", "data").mapInArrow(lambda it: _segments(it, p), f"row {ROW}, low long, n long, k long, c long"))
    classes = found.groupBy("k", "c").agg(F.count("*").alias("m"), F.min(F.struct("row", "low", "n")).alias("one"))
    classes = scratch.save(classes.select("k", "c", "m", F.col("one.row").alias("row"), F.col("one.low").alias("low"), F.col("one.n").alias("n")))
    size = F.col("n") + p.length - 1
    several = classes.groupBy("k").agg(F.count("*").alias("classes"), F.sum(size).alias("bytes")).where("classes > 1").select("k", (F.col("bytes") > p.hot_bytes).alias("hot"))
    meeting = scratch.save(classes.join(several, "k").select("k", "c", "hot", "row", "low", "n"))
    total = meeting.groupBy("hot").agg(F.sum(size).alias("bytes"), F.sum("n").alias("strings")).collect()
    total = {r["hot"]: r for r in total}

    wanted = meeting.groupBy("row").agg(F.collect_list(F.struct("k", "c", "hot", "low", "n")).alias("parts"))
    blobs = scratch.save(source.join(wanted, "row").select("data", "parts").mapInArrow(lambda it: _cut_out(it, p), "k long, c long, hot boolean, blob binary"))
    runs = "k long, c long, low long, high long"
    whole = classes.where("m > 1").select("k", "c", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    repeats = whole
    if False in total:
        shards = max(1, -(-total[False]["bytes"] // (2 * p.shard_bytes)))
        dealt = blobs.where("not hot").select("k", "c", "blob").repartition(shards, "k").sortWithinPartitions("k", "c")
        repeats = repeats.union(dealt.mapInArrow(lambda it: _shard(it, p), runs))
    if True in total:
        ranges = max(1, -(-total[True]["strings"] // p.range_strings))
        dealt = blobs.where("hot").mapInArrow(lambda it: _dealt(it, ranges, p), "part int, k long, c long, hashes binary, places binary")
        repeats = repeats.union(dealt.repartition(ranges, "part").mapInArrow(_ranged, runs))
    repeats = scratch.save(repeats)
    spans = found.select("row", F.col("low").alias("base"), "k", "c").join(repeats, ["k", "c"])
    spans = spans.groupBy("row").agg(F.collect_list(F.struct((F.col("base") + F.col("low")).alias("start"), (F.col("base") + F.col("high") - 1 + p.length).alias("stop"))).alias("found"))
    both = source.join(spans, "row", "left").select("id", "data", "found")
    return scratch.save(both.mapInArrow(_removed, "id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"))
