"""Mixing sources to target weights.

Each source's words, document after document, are packed into blocks of a
fixed length. The mix consists of output shards. For each, a multinomial draw
says how many of its slots each source fills; a source that has given all
that its target asks for is drawn no more. A source's slots run through its
blocks in the order of a pseudorandom permutation, a new one for each time
round, and a join by block index brings slots and documents together.

Only one row per source and per shard and source is held by the driver; shards
are at most MOST_SHARDS. A document's place in its source comes from sums over
chunks of documents, so that no source is one task.

Defined results: null or wordless text has size 0 and is never taken. A null
source is a source, the last one. Rows are told apart by their row keys: equal
rows and rows with null or repeated ids are taken row by row. Very long texts
span many blocks. An empty table gives an empty result. Only the three named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .store import ROW, Scratch, numbered

#: Words of a block at most; a source with fewer than 256 such blocks has shorter ones.
BLOCK_WORDS, LEAST_BLOCKS = 64, 256
#: Documents of a chunk, slots of an output shard (more if there would be too many shards), and sources that the driver may hold.
CHUNK_DOCS, SHARD_SLOTS, MOST_SHARDS, MOST_SOURCES = 8192, 1 << 16, 1 << 12, 1 << 20
#: Weights by a source's rank, repeating; what the mix holds in hundredths of the input; what a source gives at most, in times its size.
WEIGHTS, SHARE, MOST_ROUNDS = (3, 1, 2), 150, 2


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_ROUNDS) -> list[float]:
    """Shares of total by weight; what exceeds most * size is shared among the others by weight, until none exceeds."""
    out, free = [0.0] * len(sizes), [k for k in range(len(sizes)) if weights[k] > 0]
    left = float(total)
    while free and left > 0:
        weight = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight >= most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return out


def shard_counts(quota: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial draws of each shard's slots by the quotas, without exceeding them; all are used up in the end."""
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), quota.astype(np.int64).copy(), []
    share = quota / max(1, quota.sum())
    while left.sum():
        slots, drawn = min(shard_slots, int(left.sum())), np.zeros_like(left)
        while drawn.sum() < slots:
            p = np.where(left > drawn, share, 0.0)
            drawn += np.minimum(rng.multinomial(slots - int(drawn.sum()), p / p.sum()), left - drawn)
        out.append(drawn)
        left -= drawn
    return np.array(out, dtype=np.int64).reshape(len(out), len(quota))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network on the next even power of two, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (T.U(1) << half) - T.U(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size = size.astype(np.uint64)
    while len(todo):
        left, right, k, m = out[todo] >> half[todo], out[todo] & mask[todo], key[todo], mask[todo]
        for turn in range(4):
            left, right = right, left ^ (T.mix(right * T.MULTIPLIERS[turn] + k) & m)
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in T.pieces(batch.column(3)):
            size = np.diff(T.words(data, offsets)[2])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, to - at) for k in range(3)), pa.array(size.astype(np.int64))], names=["row", "id", "source", "size"])


def _slots(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, slot = batch.column("s").to_numpy(), batch.column("slot").to_numpy()
        turn = slot // blocks[s]
        key = T.mix(s.astype(np.uint64) * T.MULTIPLIERS[4] + turn.astype(np.uint64) * T.MULTIPLIERS[5] + T.U(seed))
        block = permuted(slot % blocks[s], blocks[s], key)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("s"), batch.column("slot"), pa.array(turn), pa.array(block)], names=["shard", "s", "slot", "turn", "block"])


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, fragments).

    documents: row (its key, see numbered()), id, source, size, source_size, target (words, of its source).
    fragments: what the mix holds, as shard, slot, turn (times round), row, and the words from..to (after the last) of the document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixture")
    sized = numbered(docs, scratch).select("row", F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    sized = scratch.save(sized.mapInArrow(_sizes, f"row {ROW}, id long, source string, size long"))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"]))
    sizes = np.array([r["size"] for r in found], dtype=np.int64)
    goals = targets(sizes.tolist(), [WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))], SHARE * int(sizes.sum()) / 100)
    length = np.clip(sizes // LEAST_BLOCKS, 1, BLOCK_WORDS)
    blocks = np.maximum(1, -(-sizes // length))
    quota = np.minimum(np.rint(np.array(goals) * blocks / np.maximum(1, sizes)).astype(np.int64), MOST_ROUNDS * blocks) * (sizes > 0)

    sources = spark.createDataFrame([(k, r["source"], int(sizes[k]), float(goals[k]), int(length[k])) for k, r in enumerate(found)], "s int, name string, source_size long, target double, block_words long")
    documents = sized.join(sources, sized["source"].eqNullSafe(sources["name"])).drop("name")

    chunks = max(1, -(-sum(r["docs"] for r in found) // CHUNK_DOCS))
    dealt = documents.where("size > 0").select("row", "s", "size", "block_words", F.xxhash64(F.coalesce("id", "row.place"), F.lit(seed)).alias("h")).withColumn("chunk", F.pmod("h", F.lit(chunks)))
    before = dealt.groupBy("s", "chunk").agg(F.sum("size").alias("words")).select("s", "chunk", (F.sum("words").over(Window.partitionBy("s").orderBy("chunk")) - F.col("words")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("s", "chunk").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("inside", inside).join(before, ["s", "chunk"]).select("row", "s", "size", "block_words", (F.col("before") + F.col("inside")).alias("start"))
    held = placed.withColumn("block", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
    held = held.select("row", "s", "block", F.expr("greatest(0, block * block_words - start)").alias("from"), F.expr("least(size, (block + 1) * block_words - start)").alias("to"))

    slots = max(SHARD_SLOTS, -(-int(quota.sum()) // MOST_SHARDS))
    counts = shard_counts(quota, slots, seed)
    first = np.cumsum(counts, axis=0) - counts
    plan = [(shard, s, int(first[shard, s]), int(counts[shard, s])) for shard in range(len(counts)) for s in range(len(quota)) if counts[shard, s]]
    plan = spark.createDataFrame(plan, "shard int, s int, first long, n long").repartition(max(1, min(len(plan), 4 * len(counts))), "shard", "s")
    drawn = plan.select("shard", "s", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    drawn = drawn.mapInArrow(lambda it: _slots(it, blocks, seed), "shard int, s int, slot long, turn long, block long")
    # The slots come from a short plan, whose size says nothing about theirs: they must not be broadcast.
    fragments = held.hint("merge").join(drawn.hint("merge"), ["s", "block"]).select("shard", "slot", "turn", "row", "from", "to")
    return documents.select("row", "id", "source", "size", "source_size", "target"), fragments


def taken(documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """documents with taken: the words that the mix takes from each, repeats counted."""
    words = fragments.groupBy("row").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return documents.hint("merge").join(words.hint("merge"), "row", "left").drop("row").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, parts = batch.column("text"), batch.column("parts").to_pylist()
        out = []
        for at, to, data, offsets in T.pieces(texts):
            start, stop, first = T.words(data, offsets)
            for k in range(to - at):
                n, pieces = first[k + 1] - first[k], []
                spans = sorted((p["from"], p["to"]) for p in parts[at + k])
                joined = spans[:1]
                for i, j in spans[1:]:
                    if i <= joined[-1][1]:
                        joined[-1] = (joined[-1][0], max(j, joined[-1][1]))
                    else:
                        joined.append((i, j))
                for i, j in joined:
                    a = offsets[k] if i == 0 else start[first[k] + i]
                    b = offsets[k + 1] if j == n else stop[first[k] + j - 1]
                    pieces.append(data[a:b].tobytes().decode("utf-8"))
                out.append("\n".join(pieces))
        columns = [pa.array(out, type=pa.string()) if name == "text" else column for name, column in zip(batch.schema.names, batch.columns) if name != "parts"]
        yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "parts"])


def rendered(docs: DataFrame, fragments: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (those that were mixed) as the mix holds them: a row for each document and time round, with the taken words' text in the place of its own.

    A document that is taken whole keeps its exact text; of another, taken runs of words are lines.
    """
    spans = fragments.groupBy("row", "turn").agg(F.collect_list(F.struct("from", "to")).alias("parts")).drop("turn")
    keyed = numbered(docs, Scratch(docs.sparkSession, "rendered"), "__row")
    packed = keyed.select("__row", F.struct(*[c for c in docs.columns if c != text_col]).alias("rest"), F.col(text_col).alias("text"))
    both = packed.hint("merge").join(spans.hint("merge"), F.col("__row") == F.col("row")).select("rest", "text", "parts")
    return both.mapInArrow(_rendered, both.drop("parts").schema).select("rest.*", F.col("text").alias(text_col))
