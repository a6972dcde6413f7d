"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct runs of `width` words, lower-cased in A-Z;
a document with fewer words has its whole sequence as one run. Documents with
equal sets form a class, and only a class's smallest id goes on.

Candidates come from buckets of equal bands. In each bucket, the member that
meets most others over all bands is the centre of a star, so a bucket of m
classes makes m - 1 candidates and not m * m. Stars alone could lose a link
between two rays, so a second step follows: where a bucket's classes still lie
in several components, the classes outside its largest component meet all
members of other components, in blocks of bounded size (a matrix product for
two blocks; only links leave it). At the end, each pair of classes that shares
a bucket was compared or is in one component.

Every link is confirmed on the full sets. Before the second step moves any set,
signatures (8 bits of each bin) show which classes of a bucket can have a link
outside their component at all: two sets of the least similarity agree in fewer
than MinHash.signs of the bins with a chance of about 1e-6 (5 standard deviations).

Defined results: null or wordless text has an empty set, no links, and its own
id as component. Rows with one id or with a null id are told apart by their
row keys; a null id is a component's id only where it has no other, and kept
then. Rows that repeat an id and a set are all kept, or none of them. An empty
table gives an empty result. Columns other than the two that are named are not
read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .store import KEY, ROW, Scratch, numbered

#: Bits of a shingle's hash. Two different shingles of one pair of documents with 20,000 words each agree with a chance of 1e-7.
BITS = 52

#: Shingles in a block of the second step, on either side.
LEFT_ITEMS, RIGHT_ITEMS = 1 << 15, 1 << 16


@dataclass(frozen=True)
class MinHash:
    """Parameters. A pair with similarity s meets in a bucket with a chance of 1 - (1 - s^rows)^bands: at 0.85, all but 1 of 4e7."""

    width: int = 5
    percent: int = 85
    bands: int = 30
    rows: int = 5
    seed: int = 11

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def signs(self) -> int:
        """Bins in which two signatures must agree at least."""
        share = self.percent / 100
        return int(self.bins * share - 5 * (self.bins * share * (1 - share)) ** 0.5)


def densify(signature: np.ndarray, there: np.ndarray, seed: int) -> np.ndarray:
    """Fill empty bins: each follows its own fixed random sequence of bins up to the first that isn't empty.

    The sequences depend on the bin and the attempt alone, so equal sets fill
    alike, and each empty bin chooses independently of the others.
    """
    docs, bins = signature.shape
    rng = np.random.Generator(np.random.PCG64(seed))
    doc, empty = np.nonzero(~there & there.any(axis=1)[:, None])
    while len(doc):
        pick = rng.integers(0, bins, bins)[empty]
        hit = there[doc, pick]
        signature[doc[hit], empty[hit]] = signature[doc[hit], pick[hit]]
        doc, empty = doc[~hit], empty[~hit]
    return signature


def sketches(keys: np.ndarray, docs: int, p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """((docs, bands) band hashes, (docs, bins) signatures of 8 bits) from sorted distinct (row, shingle) keys; rows without shingles have unused values."""
    row, h = (keys >> T.U(BITS)).astype(np.int64), keys & T.U((1 << BITS) - 1)
    bin_ = (((h >> T.U(BITS - 32)) * T.U(p.bins)) >> T.U(32)).astype(np.int64)
    cell = row * p.bins + bin_
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, dtype=np.int64)
    signature, there = np.zeros(docs * p.bins, dtype=np.uint64), np.zeros(docs * p.bins, dtype=bool)
    signature[cell[lead]], there[cell[lead]] = h[lead], True
    signature = T.mix(densify(signature.reshape(docs, p.bins), there.reshape(docs, p.bins), p.seed))
    bands = np.zeros((docs, p.bands), dtype=np.uint64)
    for k in range(p.rows):
        bands += signature[:, k :: p.rows] * T.MULTIPLIERS[k]
    return T.mix(bands + np.arange(p.bands, dtype=np.uint64)[None, :] * T.MULTIPLIERS[6]), signature.astype(np.uint8)


def _sketch(batches, p: MinHash):
    for batch in batches:
        for at, to, data, offsets in T.pieces(batch.column(2)):
            keys = T.shingle_keys(T.lowered(data), offsets, p.width, BITS)
            row = (keys >> T.U(BITS)).astype(np.int64)
            count = np.bincount(row, minlength=to - at)
            first = np.concatenate([[0], np.cumsum(count)])
            scrambled = T.mix(keys & T.U((1 << BITS) - 1))
            both = [np.concatenate([[T.U(0)], np.cumsum(x)]) for x in (scrambled, T.mix(scrambled + T.MULTIPLIERS[0]))]
            prints = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in both]
            bands, signs = sketches(keys, to - at, p)
            bands = bands[count > 0].view(np.int64)
            signs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(p.bins), to - at, [None, pa.py_buffer(signs.tobytes())]).cast(pa.binary())
            own = [batch.column(k).slice(at, to - at) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(count.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), T.list_column(bands.ravel(), np.where(count > 0, p.bands, 0)), signs], names=["row", "id", "n", "f", "g", "bands", "signs"])


def _sets(batches, p: MinHash):
    for batch in batches:
        ids = batch.column(0)
        for at, to, data, offsets in T.pieces(batch.column(1)):
            keys = T.shingle_keys(T.lowered(data), offsets, p.width, BITS)
            row = (keys >> T.U(BITS)).astype(np.int64)
            hashes = (keys & T.U((1 << BITS) - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), T.list_column(hashes, np.bincount(row, minlength=to - at))], names=["id", "items"])


def _hopeful(batches, p: MinHash, tile: int = 256):
    """(key, id) of the classes in two parts of a bucket that may have a link to another component there."""
    for batch in batches:
        for k in range(batch.num_rows):
            left, right = batch.column(1)[k].values, batch.column(2)[k].values
            (li, lc, ln), (ri, rc, rn) = ([side.field(c).to_numpy() for c in ("id", "comp", "n")] for side in (left, right))
            ls, rs = (np.frombuffer(b"".join(side.field("signs").to_pylist()), dtype=np.uint8).reshape(-1, p.bins) for side in (left, right))
            found = []
            for at in range(0, len(li), tile):
                a = slice(at, at + tile)
                for to in range(0, len(ri), tile):
                    b = slice(to, to + tile)
                    may = (lc[a, None] != rc[None, b]) & (100 * np.minimum(ln[a, None], rn[None, b]) >= p.percent * np.maximum(ln[a, None], rn[None, b]))
                    i, j = np.nonzero(may)
                    for low in range(0, len(i), 1 << 14):
                        x, y = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
                        good = (ls[a][x] == rs[b][y]).sum(axis=1) >= p.signs
                        found += [li[a][x[good]], ri[b][y[good]]]
                        found = [np.unique(np.concatenate(found))]
            if found and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), batch.column(0)[k].as_py())), pa.array(found[0])], names=["key", "id"])


def _confirm(batches, percent: int):
    """Pairs whose sets are similar enough; both sets are sorted and distinct."""
    for batch in batches:
        a, b, left, right = (batch.column(k) for k in range(4))
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy(), right.values.to_numpy()
        keep = np.zeros(batch.num_rows, dtype=bool)
        for k in range(batch.num_rows):
            x, y = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
            both = np.concatenate([x, y])
            both.sort()
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[k] = 100 * same >= percent * (len(both) - same)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def _blocks(rows: DataFrame, what: DataFrame, column: str, items: int) -> DataFrame:
    """(key, block): a bucket's classes with `column` of what, in blocks of about `items` shingles; a larger set is about a block of its own."""
    parts = rows.groupBy("key").agg(F.ceil(F.sum("n") / items).alias("parts"))
    dealt = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    return dealt.join(what, "id").groupBy("key", "part").agg(F.collect_list(F.struct("id", "comp", "n", column)).alias("block")).drop("part")


def _incidence(codes: np.ndarray, row: np.ndarray, rows: int, low: int, high: int) -> np.ndarray:
    out = np.zeros((rows, high - low), dtype=np.float32)
    here = (codes >= low) & (codes < high)
    out[row[here], codes[here] - low] = 1
    return out


def _compare(batches, percent: int, columns: int = 4096, tile: int = 1024):
    """Links between two blocks' components, from exact intersection sizes of their classes."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, comps, items, rows = [], [], [], []
            for side in (0, 1):
                block = batch.column(side)[k].values
                lists = block.field("items")
                ids.append(block.field("id").to_numpy())
                comps.append(block.field("comp").to_numpy())
                items.append(lists.flatten().to_numpy())
                rows.append(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())))
            size = [np.bincount(r, minlength=len(i)).astype(np.float32) for r, i in zip(rows, ids)]
            both = np.intersect1d(items[0], items[1])
            codes = [np.searchsorted(both, x) for x in items]
            for side in (0, 1):
                there = both[np.minimum(codes[side], len(both) - 1)] == items[side] if len(both) else np.zeros(len(items[side]), dtype=bool)
                codes[side], rows[side] = codes[side][there], rows[side][there]
            cuts = [np.searchsorted(r, np.arange(0, len(i) + tile, tile)) for r, i in zip(rows, ids)]
            found = []
            # Short sets make blocks of many rows, so that the products are made of tiles of bounded size.
            for i in range(0, len(ids[0]), tile):
                left, mine = slice(*cuts[0][i // tile : i // tile + 2]), slice(i, i + tile)
                for j in range(0, len(ids[1]), tile):
                    right, other = slice(*cuts[1][j // tile : j // tile + 2]), slice(j, j + tile)
                    same = np.zeros((len(size[0][mine]), len(size[1][other])), dtype=np.float32)
                    for low in range(0, len(both), columns):
                        high = min(low + columns, len(both))
                        same += _incidence(codes[0][left], rows[0][left] - i, same.shape[0], low, high) @ _incidence(codes[1][right], rows[1][right] - j, same.shape[1], low, high).T
                    total = size[0][mine][:, None] + size[1][other][None, :] - same
                    a, b = np.nonzero((100 * same >= percent * total) & (comps[0][mine][:, None] != comps[1][other][None, :]))
                    a, b = comps[0][mine][a], comps[1][other][b]
                    found.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHash | None = None) -> DataFrame:
    """Per document: row (its key, see numbered()), id, n_shingles, component_id, stays (it is its component's first, by id and row key, or has no words)."""
    p = params or MinHash()
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = numbered(docs, scratch, "row").select("row", F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.save(source.mapInArrow(lambda it: _sketch(it, p), f"row {ROW}, id long, n long, f long, g long, bands array<long>, signs binary"))

    classes = sketch.where("n > 0").groupBy("f", "g", "n").agg(F.min(F.struct(F.isnull("id").alias("last"), "id", "row")).alias("first"))
    classes = scratch.save(classes.withColumn("row", F.col("first.row")).withColumn("v", F.monotonically_increasing_id()))
    own = scratch.save(sketch.select("row", "n", "bands", "signs").join(classes.select("row", F.col("v").alias("id")), "row"))
    members = own.select("id", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = scratch.save(members.join(shared, "key").select("key", "id", "n", "m"))
    degree = members.groupBy("id").agg(F.sum("m").alias("degree"))
    members = scratch.save(members.join(degree, "id"))

    # The wanted ids grow with the table, so they are not broadcast, and texts move once.
    wanted = own.select("row", "id").join(degree.select("id"), "id", "left_semi")
    sets = source.select("row", "text").hint("merge").join(wanted, "row").select("id", "text")
    sets = scratch.save(sets.mapInArrow(lambda it: _sets(it, p), "id long, items array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b")
        return scratch.save(both.select("a", "b", "left", "right").mapInArrow(lambda it: _confirm(it, p.percent), "a long, b long"))

    sized = f"100 * least(n, cn) >= {p.percent} * greatest(n, cn)"
    pair = [F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")]
    centre = members.groupBy("key").agg(F.max(F.struct("degree", -F.col("id"), F.col("id").alias("c"), F.col("n").alias("cn"))).alias("best")).select("key", "best.c", "best.cn")
    links = confirmed(scratch.save(members.join(centre, "key").where("id <> c").where(sized).select(*pair).distinct()))
    groups = scratch.save(components(links, scratch))

    # A bucket whose classes still lie in several components may hold a link that no star has seen.
    wide = members.where("m > 2").select("key", "id", "n")
    placed = wide.join(groups, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", -F.col("comp"), "comp")).alias("best"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("best.comp").alias("main"))
    placed = scratch.save(placed.join(main, "key"))
    signs = own.select("id", "signs")
    outside = _blocks(placed.where("comp <> main"), signs, "signs", RIGHT_ITEMS).withColumnRenamed("block", "left")
    inside = _blocks(placed, signs, "signs", RIGHT_ITEMS).withColumnRenamed("block", "right")
    hopeful = scratch.save(outside.join(inside, "key").select("key", "left", "right").mapInArrow(lambda it: _hopeful(it, p), "key long, id long").distinct())
    placed = placed.join(hopeful, ["key", "id"])
    outside = _blocks(placed.where("comp <> main"), sets, "items", LEFT_ITEMS).withColumnRenamed("block", "left")
    inside = _blocks(placed, sets, "items", RIGHT_ITEMS).withColumnRenamed("block", "right")
    found = scratch.save(outside.join(inside, "key").select("left", "right").mapInArrow(lambda it: _compare(it, p.percent), "a long, b long").distinct())
    joined = components(found, scratch).select(F.col("id").alias("component"), F.col("component").alias("whole"))

    groups = groups.join(joined, "component", "left").select(F.col("id").alias("v"), F.coalesce("whole", "component").alias("component"))
    groups = classes.join(groups, "v", "left").join(joined.withColumnRenamed("component", "v").withColumnRenamed("whole", "lone"), "v", "left").select("f", "g", "n", "first", F.coalesce("component", "lone", "v").alias("component"))
    least = groups.groupBy("component").agg(F.min("first").alias("least"))
    least = groups.join(least, "component").select("f", "g", "n", F.lit(True).alias("valid"), "least")
    out = sketch.select("row", "id", "n", "f", "g").join(least, ["f", "g", "n"], "left")
    component = F.when(F.col("valid"), F.col("least.id")).otherwise(F.col("id"))
    return out.select("row", "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("row") == F.col("least.row"), F.lit(True)).alias("stays"))


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHash | None = None) -> DataFrame:
    """Per document: id_col, n_shingles (set size), component_id (smallest id reachable by links), kept (it is its component's smallest)."""
    found = near_groups(docs, id_col, text_col, params)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHash | None = None) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, and of rows with one id the first by its key. Documents without words stay."""
    keyed = numbered(docs, Scratch(docs.sparkSession, "minhash"), KEY)
    stays = near_groups(docs, id_col, text_col, params).where("stays").select(F.col("row").alias(KEY))
    return keyed.join(stays, KEY, "left_semi").drop(KEY)
