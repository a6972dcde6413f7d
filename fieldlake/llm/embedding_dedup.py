"""Embedding near-dedup with an inverted multi-index.

Vectors with equal bytes are one class. Two codebooks, one for each half of
the vector, form a product grid whose cells hold the classes. A query visits
cells in the order of the sum of its two squared distances (the multi-sequence
order), up to the number of cells that reaches the target recall both on made
neighbours of sampled vectors, at the least cosine that is a link, and on the
sample's own linked pairs. Cells are dealt to groups of about GROUP classes; a
query goes once to each group that holds a cell of its visits, and all pairs of
query and group are verified by cosine in double precision. Up to about GROUP
times the visited cells, queries meet nearly all groups: the work then grows
with the square of the classes.

Groups and their visitors are dealt in blocks of bounded size, and two blocks
meet in one matrix product, in single precision with a margin; what passes is
decided in double precision. What leaves two blocks are counts, and for the
components a spanning forest of their links: at most one row for each vector,
never a row for each pair. A link counts for both its vectors, whichever of
them has found it: where the other one doesn't come back, its count is written
too.

Bounds: the codebooks and the number of visited cells are fitted on at most
SAMPLE vectors, chosen by a hash of their bytes; every vector is indexed and every
vector is a query. Codebooks grow with the square root of the vectors, up to
MOST_WORDS; beyond MOST_WORDS^2 * PER_CELL vectors, cells grow instead.

Defined results: a vector that is null, empty or zero, or holds null or
non-finite components, has no links and its own id as component. Vectors of
different lengths have no links. Rows with one id or with a null id have their
own links each; a null id is a component's id only where it has no other, and
kept then. An empty table gives an empty result. Only the two named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import Scratch

#: Vectors to fit on; classes of a cell, about; codewords at most; vectors of a block; visited cells at least; share of made neighbours to reach from one side; classes of a group, about; made neighbours.
SAMPLE, PER_CELL, MOST_WORDS, BLOCK, LEAST_CELLS, RECALL, GROUP, MADE = 16384, 8, 4096, 2048, 8, 0.999, 8192, 8192

#: Below the least cosine by which a product in single precision still counts as a candidate (its error is about 1e-6).
MARGIN = 1e-4

#: Rows of a table of distances that the driver holds at once.
ROWS = 1024


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        width = lists.value_lengths().fill_null(0).to_numpy()
        values = lists.flatten()
        flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(width)
        out: list = []
        for k in range(batch.num_rows):
            v = flat[ends[k] - width[k] : ends[k]]
            with np.errstate(all="ignore"):
                top = np.abs(v).max() if len(v) else 0.0
                norm = np.sqrt(((v / top) ** 2).sum()) if top > 0 and np.isfinite(top) else np.nan
            out.append((v / top / norm).tobytes() if np.isfinite(norm) and norm > 0 else None)
        keys = [blake2b(x, digest_size=16).digest() if x is not None else None for x in out]
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.where([x is not None for x in out], width, 0).astype(np.int32)), pa.array(keys, type=pa.binary()), pa.array(out, type=pa.binary())], names=["id", "dim", "key", "unit"])


def _matrix(units: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), dtype=np.float64).reshape(-1, dim)


def codebook(x: np.ndarray, words: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means by Lloyd's rounds; an empty cluster takes the vector that is farthest from its word."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = x[rng.choice(len(x), words, replace=False)].copy()
    for _ in range(rounds):
        near, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for at in range(0, len(x), ROWS):
            d = distances(x[at : at + ROWS], out)
            near[at : at + ROWS], far[at : at + ROWS] = d.argmin(axis=1), d.min(axis=1)
        count = np.bincount(near, minlength=words)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out[count > 0] = sums[count > 0] / count[count > 0, None]
        lost = np.flatnonzero(count == 0)
        out[lost] = x[np.argsort(-far, kind="stable")[: len(lost)]]
    return out


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances, not below 0."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None, :])


def visited(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """(queries, cells): each query's nearest grid cells i * words + j, by multi-sequence traversal.

    The n nearest cells lie among the pairs of ranks (a, b) with
    (a + 1) * (b + 1) <= n: every cell with both ranks lower comes no later.
    """
    words = d1.shape[1]
    cells = min(cells, words * words)
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    a, b = np.array([(a, b) for a in range(words) for b in range(min(words, cells // (a + 1)))], dtype=np.int64).T
    total = s1[:, a] + s2[:, b]
    best = np.argpartition(total, cells - 1, axis=1)[:, :cells] if cells < len(a) else np.tile(np.arange(len(a)), (len(d1), 1))
    return np.take_along_axis(o1, a[best], 1) * words + np.take_along_axis(o2, b[best], 1)


def cells_for(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], least_cosine: float, recall: float = RECALL, most_pairs: int = 20000) -> int:
    """The number of cells that a query must visit to find `recall` of made neighbours at least_cosine, and of the sample's linked pairs.

    Made neighbours, one in a random direction from each of MADE vectors, always
    exist. So do the links of MADE vectors to the rest of the sample, if there
    are any; most_pairs of them are tried.
    """
    half, words = x.shape[1] // 2, len(books[0])
    rng = np.random.Generator(np.random.PCG64(3))

    def rank(q: np.ndarray, v: np.ndarray) -> int:
        """The `recall` quantile of the number of cells no farther from q[k] than the cell of v[k]."""
        ranks = []
        for at in range(0, len(q), ROWS):
            d1, d2, e1, e2 = (distances(y[at : at + ROWS, part], book) for y in (q, v) for part, book in ((slice(half), books[0]), (slice(half, None), books[1])))
            s2, reach = np.sort(d2, axis=1), [np.take_along_axis(d, e.argmin(axis=1)[:, None], 1)[:, 0] for d, e in ((d1, e1), (d2, e2))]
            ranks += [int(np.searchsorted(s2[k], total - d1[k], side="right").sum()) for k, total in enumerate(reach[0] + reach[1])]
        return int(np.quantile(ranks, recall, method="higher"))

    base = rng.permutation(len(x))[:MADE]
    aside = rng.normal(size=(len(base), x.shape[1]))
    aside -= (aside * x[base]).sum(axis=1)[:, None] * x[base]
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1)), 1e-300)[:, None]
    cells = max(LEAST_CELLS, rank(x[base], least_cosine * x[base] + np.sqrt(max(0.0, 1 - least_cosine**2)) * aside))
    q, v = [], []
    for at in range(0, len(base), 256):
        i, j = np.nonzero(x[base[at : at + 256]] @ x.T >= least_cosine)
        i = base[at + i]
        q.append(i[i != j])
        v.append(j[i != j])
    q, v = np.concatenate(q), np.concatenate(v)
    if len(q):
        pick = rng.permutation(len(q))[:most_pairs]
        cells = max(cells, rank(x[q[pick]], x[v[pick]]))
    return min(words * words, cells)


def _placed(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray], cells: int, groups: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Each class with its own group as `cell`, and the groups of the cells that it visits, its own among them."""
    words, half = len(books[0]), dim // 2
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x = _matrix(part.column("unit"), dim)
            d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
            own = (d1.argmin(axis=1) * words + d2.argmin(axis=1)) % groups
            seen = np.sort(np.concatenate([visited(d1, d2, cells) % groups, own[:, None]], axis=1), axis=1)
            new = np.concatenate([np.ones((len(x), 1), dtype=bool), seen[:, 1:] != seen[:, :-1]], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)), pa.array(seen[new].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), part.column("unit"), pa.array(own.astype(np.int32)), lists], names=["id", "copies", "unit", "cell", "visits"])


def _blocks(rows: DataFrame, more: str) -> DataFrame:
    """(cell, block): a cell's rows in blocks of about BLOCK, with one more column."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "copies", "unit", more)).alias("block")).drop("part")


def _pairs(x: np.ndarray, y: np.ndarray, least: float, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) whose product is at least `least`, in double precision."""
    x32, y32, found = x.astype(np.float32), y.astype(np.float32), []
    for at in range(0, len(x), tile):
        a, b = np.nonzero(x32[at : at + tile] @ y32.T >= np.float32(least - MARGIN))
        for low in range(0, len(a), 1 << 16):
            i, j = a[low : low + (1 << 16)] + at, b[low : low + (1 << 16)]
            good = np.einsum("ij,ij->i", x[i], y[j]) >= least
            found.append((i[good], j[good]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2


def _verified(batches: Iterator[pa.RecordBatch], least: float, dim: int, groups: int) -> Iterator[pa.RecordBatch]:
    """kind 0: (id, links found, weighted by copies); kind 1: (id, smaller id) of a spanning forest."""
    for batch in batches:
        for k in range(batch.num_rows):
            q, v = batch.column(0)[k].values, batch.column(1)[k].values
            qi, vi = q.field("id").to_numpy(), v.field("id").to_numpy()
            a, b = _pairs(_matrix(q.field("unit"), dim), _matrix(v.field("unit"), dim), least)
            other = qi[a] != vi[b]
            a, b = a[other], b[other]
            if not len(a):
                continue
            count = np.bincount(a, v.field("copies").to_numpy()[b], len(qi))
            # Of a pair, v counts its own link when it visits the group of q; if it doesn't, the link is counted for it here.
            visits = v.field("visits")
            back = np.repeat(np.arange(len(vi)), visits.value_lengths().to_numpy()) * groups + visits.flatten().to_numpy()
            want = b * groups + q.field("own").to_numpy()[a]
            alone = back[np.minimum(np.searchsorted(back, want), len(back) - 1)] != want
            extra = np.bincount(b[alone], q.field("copies").to_numpy()[a[alone]], len(vi))
            lq, lv = qi.copy(), vi.copy()
            while True:
                nq, nv = lq.copy(), lv.copy()
                np.minimum.at(nv, b, lq[a])
                np.minimum.at(nq, a, nv[b])
                if (nv == lv).all() and (nq == lq).all():
                    break
                lq, lv = nq, nv
            ids, labels, counts = np.concatenate([qi, vi]), np.concatenate([lq, lv]), np.concatenate([count, extra])
            forest, found = ids != labels, counts > 0
            n, m = int(found.sum()), int(forest.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), pa.array(np.concatenate([ids[found], ids[forest]])), pa.array(np.concatenate([counts[found].astype(np.int64), labels[forest]]))], names=["kind", "a", "b"])


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = 0.9) -> DataFrame:
    """Per vector: id_col, n_links (other vectors found linked), component_id (smallest id reachable), kept."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    clean = scratch.save(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_clean, "id long, dim int, key binary, unit binary"))
    classes = clean.where("dim > 0").groupBy("dim", "key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()))
    found = []
    for r in classes.groupBy("dim").count().orderBy("dim").collect():
        dim, n = r["dim"], r["count"]
        own = classes.where(F.col("dim") == dim)
        sample = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < min(1 << 30, SAMPLE * (1 << 30) // n)).select("unit").orderBy("unit").limit(2 * SAMPLE).toArrow()
        x = _matrix(sample.column("unit"), dim) if sample.num_rows else np.zeros((0, dim))
        words = max(1, min(MOST_WORDS, int(np.sqrt(n / PER_CELL)), len(x) // 4))
        half = dim // 2
        books = (codebook(x[:, :half], words, 1), codebook(x[:, half:], words, 2)) if words > 1 else (np.zeros((1, half)), np.zeros((1, dim - half)))
        cells = cells_for(x, books, least_cosine) if words > 1 else 1
        groups = -(-n // GROUP)
        placed = scratch.save(own.select("id", "copies", "unit").mapInArrow(lambda it, books=books, cells=cells, groups=groups, dim=dim: _placed(it, books, cells, groups, dim), "id long, copies long, unit binary, cell int, visits array<int>"))
        inside = _blocks(placed, "visits")
        held = placed.select("cell").distinct().withColumnRenamed("cell", "to")
        visits = placed.select("id", "copies", "unit", F.col("cell").alias("own"), F.explode("visits").alias("to")).join(held, "to", "left_semi")
        both = _blocks(visits.select("id", "copies", "unit", F.col("to").alias("cell"), F.col("own")), "own").withColumnRenamed("block", "q").join(inside.withColumnRenamed("block", "v"), "cell").select("q", "v")
        found.append(scratch.save(both.mapInArrow(lambda it, dim=dim, groups=groups: _verified(it, least_cosine, dim, groups), "kind int, a long, b long")))
    links = clean.sparkSession.createDataFrame([], "kind int, a long, b long") if not found else found[0]
    for x in found[1:]:
        links = links.union(x)
    counts = links.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
    groups = components(links.where("kind = 1").select("a", "b"), scratch)
    classes = classes.select("dim", "key", "id", "first", "copies").join(counts, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    classes = classes.join(least, "component").select("dim", "key", F.lit(True).alias("valid"), "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = clean.select("id", "dim", "key").join(classes, ["dim", "key"], "left")
    component = F.when(F.col("valid"), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
