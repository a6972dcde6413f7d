"""How well vectors predict labels: repeated group folds, and a null of permuted labels."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .folds import feasible_folds

RUNS = "kind string, iteration int, seed int, balanced_accuracy double, macro_f1 double, top3_accuracy double, confusion array<double>"


def minimise(value, start: np.ndarray, steps: int = 300, memory: int = 10, tolerance: float | np.ndarray = 1e-6) -> np.ndarray:
    """The least points of smooth convex functions, one for each row of start: limited-memory quasi-Newton steps, halved until the value falls.

    value(points, which) gives the values and gradients of the functions
    `which` at their points. All functions advance together, so that one call
    serves a step of each that has not ended.
    """
    x, count = start.astype(np.float64), len(start)
    f, g = value(x, np.arange(count))
    f, g = f.copy(), g.copy()
    tolerance, taken = np.broadcast_to(tolerance, count), np.zeros(count, dtype=np.int64)
    pairs: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in range(count)]
    way, slope, step = np.zeros_like(x), np.zeros(count), np.ones(count)

    def turn(n: int) -> None:
        q, used = g[n].copy(), []
        for s, y, r in reversed(pairs[n]):
            a = r * (s @ q)
            q -= a * y
            used.append(a)
        if pairs[n]:
            s, y, r = pairs[n][-1]
            q /= r * (y @ y)
        else:
            q /= max(1.0, np.abs(g[n]).sum())
        for (s, y, r), a in zip(pairs[n], reversed(used)):
            q += s * (a - r * (y @ q))
        way[n], slope[n], step[n] = q, -(g[n] @ q), 1.0

    live = np.flatnonzero(np.abs(g).max(axis=1) > tolerance)
    for n in live:
        turn(n)
    while len(live):
        moved = x[live] - step[live, None] * way[live]
        f2, g2 = value(moved, live)
        rest = []
        for k, n in enumerate(live):
            if f2[k] > f[n] + 1e-4 * step[n] * slope[n] and step[n] >= 1e-10:
                step[n] /= 2
                rest.append(n)
                continue
            s, y = moved[k] - x[n], g2[k] - g[n]
            if s @ y > 1e-12:
                pairs[n] = [*pairs[n][-memory + 1 :], (s, y, 1 / (s @ y))]
            if not f2[k] < f[n]:
                continue
            x[n], f[n], g[n], taken[n] = moved[k], f2[k], g2[k], taken[n] + 1
            if taken[n] < steps and np.abs(g[n]).max() > tolerance[n]:
                turn(n)
                rest.append(n)
        live = np.array(rest, dtype=np.int64)
    return x


def parts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the weight of a row of each class, 0 or -inf to add to its logits) for rows of each class in the last axis; the classes that there are weigh the same."""
    n, kinds = count.sum(axis=-1, keepdims=True), np.count_nonzero(count, axis=-1, keepdims=True)
    return n / (np.maximum(kinds, 1) * np.maximum(count, 1)), np.where(count > 0, 0.0, -np.inf)


#: Logits that are held at once.
CELLS = 1 << 19


def loss(x: np.ndarray, y: np.ndarray, flat: np.ndarray, weight: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, gradients) without penalty, over rows x, of the models in flat's rows: width * classes weights, then an offset for each class. y, weight and seen have a row for each model."""
    models, classes = seen.shape
    rows, width = x.shape
    f, g = np.zeros(models), np.zeros(flat.shape)
    w, b = flat[:, : width * classes].reshape(models, width, classes), flat[:, width * classes :] + seen
    for first in range(0, models, most := max(1, CELLS // classes // 256)):
        m = slice(first, first + most)
        some = len(b[m])
        stacked = w[m].transpose(1, 0, 2).reshape(width, some * classes)
        for at in range(0, rows, size := max(1, CELLS // (some * classes))):
            part, truth = x[at : at + size], y[m, at : at + size].T
            z = (part @ stacked).reshape(len(part), some, classes) + b[m]
            i, j = np.arange(len(part))[:, None], np.arange(some)[None, :]
            own, each = z[i, j, truth], weight[m][j, truth]
            top = z.max(axis=2)
            z -= top[:, :, None]
            np.exp(z, out=z)
            total = z.sum(axis=2)
            f[m] += (each * (np.log(total) + top - own)).sum(axis=0)
            z *= (each / total)[:, :, None]
            z[i, j, truth] -= each
            g[m, : width * classes] += (part.T @ z.reshape(len(part), -1)).reshape(width, some, classes).transpose(1, 0, 2).reshape(some, -1)
            g[m, width * classes :] += z.sum(axis=0)
    return f, g


def multinomial(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, offsets) of logistic regression over classes, which weigh the same; the squared weights count half of penalty."""
    size = x.shape[1] * classes
    weight, seen = parts(np.bincount(y, minlength=classes)[None, :])
    flat = minimise(lambda at, which: penalised(at, loss(x, y[None, :], at, weight, seen), size, penalty), np.zeros((1, size + classes)))[0]
    return flat[:size].reshape(-1, classes), flat[size:] + seen[0]


def penalised(flat: np.ndarray, found: tuple[np.ndarray, np.ndarray], size: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """found, a loss and its gradient, with half of penalty for the squares of the first `size` numbers of each model."""
    f, g = found[0] + penalty / 2 * (flat[:, :size] ** 2).sum(axis=1), found[1].copy()
    g[:, :size] += penalty * flat[:, :size]
    return f, g


def out_of_fold_logits(x: np.ndarray, y: np.ndarray, fold: np.ndarray, classes: int) -> np.ndarray:
    """Each row's logits by a model of the other folds, standardised by them."""
    out = np.zeros((len(x), classes))
    for f in np.unique(fold):
        train, held = fold != f, fold == f
        centre, spread = x[train].mean(axis=0), x[train].std(axis=0)
        scaled = (x - centre) / np.where(spread > 0, spread, 1)
        w, b = multinomial(scaled[train], y[train], classes)
        out[held] = scaled[held] @ w + b
    return out


def counted(y: np.ndarray, logits: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows by true and predicted class, and rows whose class is one of the first three. The first of tied classes counts as predicted."""
    classes = logits.shape[1]
    table = np.zeros((classes, classes))
    np.add.at(table, (y, logits.argmax(axis=1)), 1)
    first = np.argsort(-logits, axis=1, kind="stable")[:, :3]
    return table, int((first == y[:, None]).any(axis=1).sum())


def measured(table: np.ndarray, top: int) -> tuple[float, float, float, np.ndarray]:
    """Balanced accuracy, macro F1, top-3 accuracy, and the confusion as shares of each true class, of what counted() gives."""
    true, said, hit = table.sum(axis=1), table.sum(axis=0), np.diag(table)
    present = true > 0
    share = table / np.where(present, true, 1)[:, None]
    f1 = 2 * hit / np.maximum(true + said, 1)
    return float(np.diag(share)[present].mean()), float(f1[true + said > 0].mean()), float(top / true.sum()), share


def scores(y: np.ndarray, logits: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """measured() of rows' classes and logits."""
    return measured(*counted(y, logits))


#: Rows of a block of labelled vectors.
BLOCK = 4096

_blocks = "block long, rows int, x binary, y binary, fold binary"


def _blocked(rows: DataFrame, repeats: int, permutations: int, counts: np.ndarray, order: list[int], seed: int) -> DataFrame:
    """Blocks of rows: their vectors, labels by run and folds by repeat. rows: block, key, vector, y, folds.

    A permutation deals the labels' counts over blocks at random (counts: rows
    of each block and class, order: the blocks' numbers) and shuffles them
    inside each, which makes every order of the labels equally likely.
    """
    sizes, total = counts.sum(axis=1), counts.sum(axis=0)
    dealt = np.zeros((permutations, *counts.shape), dtype=np.int64)
    for turn in range(permutations):
        rng, left = np.random.default_rng([seed, turn]), total.copy()
        for k, n in enumerate(sizes):
            # One class after the other: what is left of it against all that are left.
            want, others = int(n), int(left.sum())
            for c in range(len(total)):
                others -= int(left[c])
                dealt[turn, k, c] = rng.hypergeometric(int(left[c]), others, want) if want else 0
                want -= int(dealt[turn, k, c])
            left -= dealt[turn, k]
    place, shared = {b: k for k, b in enumerate(order)}, rows.sparkSession.sparkContext.broadcast(dealt)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        block = int(part["block"].iloc[0])
        part = part.assign(v=[tuple(v) for v in part["vector"]]).sort_values(["key", "y", "v"], kind="stable")
        truth = part["y"].to_numpy(np.int32)
        y = [truth] * repeats
        for turn in range(permutations):
            labels, own = np.repeat(np.arange(counts.shape[1], dtype=np.int32), shared.value[turn, place[block]]), [seed, turn, block]
            if len(order) == 1:  # nothing to deal: the labels themselves, in the order of keys
                labels, own = truth, [seed, turn]
            y.append(np.random.default_rng(own).permutation(labels))
        x, fold = np.array(part["vector"].tolist(), dtype=np.float64), np.array(part["folds"].tolist(), dtype=np.int32).T
        return pd.DataFrame({"block": [block], "rows": [len(part)], "x": [x.tobytes()], "y": [np.stack(y).tobytes()], "fold": [np.ascontiguousarray(fold).tobytes()]})

    return rows.groupBy("block").applyInPandas(pack, _blocks).persist(StorageLevel.MEMORY_AND_DISK)


def _over(blocks: DataFrame, runs: int, each) -> list:
    """What each(x, y, fold) gives for every block, as sent by each partition: a list of lists. y: a row for each run, fold: one for each repeat."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            for rows, x, y, fold in zip(part["rows"], part["x"], part["y"], part["fold"]):
                found = each(np.frombuffer(x).reshape(rows, -1), np.frombuffer(y, dtype=np.int32).reshape(runs, rows), np.frombuffer(fold, dtype=np.int32).reshape(-1, rows))
                total = found if total is None else merge(total, found)
        if total is not None:
            yield pd.DataFrame({"found": [pickle.dumps(total)]})

    def merge(a, b):
        return [u + v for u, v in zip(a, b)]

    found = [pickle.loads(r["found"]) for r in blocks.mapInPandas(solve, "found binary").collect()]
    out = found[0]
    for other in found[1:]:
        out = merge(out, other)
    return out


def evidence(df: DataFrame, key: str, vector: str, label: str, group: str, k: int = 3, repeats: int = 5, permutations: int = 100, seed: int = 0, most_rows: int | None = None, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """Runs (repeats, each over its own feasible group folds, and permutations of labels over the first folds), and the labels in the order of their confusion.

    Any number of rows: they stay in blocks on the executors, and each step of
    all models is one pass over the blocks, of which only sums reach the
    driver (for each run and fold, the size of its model). most_rows makes
    more rows an error. Rows without a vector or label are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"), F.col(group).cast("string").alias("unit"))
    held = rows.count()
    if most_rows is not None and held > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    if not held:
        raise ValueError("no labelled rows")
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())
    used: list[int] = []
    placed = rows.select("unit").distinct()
    for repeat in range(repeats):
        folds, found = feasible_folds(rows, "unit", "label", k, seed + repeat)
        while found in used:
            folds, found = feasible_folds(rows, "unit", "label", k, found + 1)
        used.append(found)
        placed = placed.join(folds.select("unit", F.col("fold").alias(f"f{repeat}")).distinct(), "unit")
    numbered = spark.createDataFrame(list(zip(names, range(len(names)))), "label string, y int")
    # Equal keys are spread by their rows; rows equal in all are alike wherever they lie.
    at = F.pmod(F.xxhash64(F.lit(seed), "key", "label", "unit", "vector"), F.lit(-(-held // block)))
    rows = rows.join(numbered, "label").join(placed, "unit").select(at.alias("block"), "key", "vector", "y", F.array(*[f"f{r}" for r in range(repeats)]).alias("folds"))
    cells = rows.groupBy("block", "y").agg(F.count("*").alias("n")).collect()
    order = sorted({r["block"] for r in cells})
    place = {b: n for n, b in enumerate(order)}
    counts = np.zeros((len(order), len(names)), dtype=np.int64)
    for r in cells:
        counts[place[r["block"]], r["y"]] = r["n"]
    blocks = _blocked(rows, repeats, permutations, counts, order, seed)
    runs, classes = repeats + permutations, len(names)
    dealt = [r if r < repeats else 0 for r in range(runs)]  # the folds of each run

    # Rows, sums and counts of labels of each fold; a training part is all but one.
    def summed(x, y, fold):
        inside = (fold[:, None, :] == np.arange(k)[None, :, None]).astype(np.float64)
        label = np.stack([[np.bincount(y[r][fold[dealt[r]] == f], minlength=classes) for f in range(k)] for r in range(runs)])
        return [inside.sum(axis=2), inside @ x, label]

    n, sums, label = _over(blocks, runs, summed)
    n, sums, label = (v.sum(axis=1, keepdims=True) - v for v in (n, sums, label))
    centre = sums / np.maximum(n, 1)[:, :, None]

    def spread(x, y, fold):
        return [np.stack([[((x[fold[r] != f] - centre[r, f]) ** 2).sum(axis=0) for f in range(k)] for r in range(len(fold))])]

    deviation = np.sqrt(_over(blocks, runs, spread)[0] / np.maximum(n, 1)[:, :, None])
    deviation = np.where(deviation > 0, deviation, 1)
    weight, seen = parts(label)
    width = centre.shape[2]
    size = width * classes
    # Model m is that of run m // k and held fold m % k; those over the same rows are solved together.
    alike = [(r, f, np.array([m * k + f for m in range(runs) if dealt[m] == r])) for r in range(repeats) for f in range(k)]
    weight, seen = weight.reshape(runs * k, classes), seen.reshape(runs * k, classes)

    def value(flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [(r, f, np.flatnonzero(np.isin(which, models))) for r, f, models in alike]
        own = [(r, f, at, which[at] // k, flat[at], weight[which[at]], seen[which[at]]) for r, f, at in own if len(at)]

        def step(x, y, fold):
            f, g = np.zeros(len(which)), np.zeros(flat.shape)
            for r, out, at, run, points, w, s in own:
                train = fold[r] != out
                f[at], g[at] = loss((x[train] - centre[r, out]) / deviation[r, out], y[run][:, train], points, w, s)
            return [f, g]

        return penalised(flat, tuple(_over(blocks, runs, step)), size, 1.0)

    flat = minimise(value, np.zeros((runs * k, size + classes)), tolerance=np.maximum(1e-6, 1e-8 * n[dealt].reshape(-1)))

    def judged(x, y, fold):
        table, top = np.zeros((runs, classes, classes)), np.zeros(runs, dtype=np.int64)
        for r, out, models in alike:
            there = fold[r] == out
            scaled = (x[there] - centre[r, out]) / deviation[r, out]
            for m in models:
                found = counted(y[m // k][there], scaled @ flat[m, :size].reshape(width, classes) + flat[m, size:] + seen[m])
                table[m // k] += found[0]
                top[m // k] += found[1]
        return [table, top]

    table, top = _over(blocks, runs, judged)
    blocks.unpersist()
    out = []
    for m in range(runs):
        kind, turn, at = ("repeat", m, used[m]) if m < repeats else ("permutation", m - repeats, seed + m - repeats)
        accuracy, f1, three, share = measured(table[m], int(top[m]))
        out.append((kind, turn, at, accuracy, f1, three, share.ravel().tolist()))
    return spark.createDataFrame(out, RUNS), names


def recalls(runs: DataFrame, names: list[str]) -> DataFrame:
    """iteration, seed, label, predicted, share: the confusion of each repeat; a label's recall is its share where predicted is the label."""
    cells = runs.where("kind = 'repeat'").select("iteration", "seed", F.posexplode("confusion").alias("at", "share"))
    name = F.array(*[F.lit(n) for n in names])
    return cells.select("iteration", "seed", name[F.floor(F.col("at") / len(names)).cast("int")].alias("label"), name[F.col("at") % len(names)].alias("predicted"), "share")


def summary(runs: DataFrame) -> DataFrame:
    """One row: mean and deviation of the repeats' measures, the null's mean and 95 % point, and p = (1 + null at or above the mean) / (1 + permutations)."""
    mine, null = F.col("kind") == "repeat", F.col("kind") == "permutation"
    part = lambda c, which: F.when(which, F.col(c))
    measures = ("balanced_accuracy", "macro_f1", "top3_accuracy")
    spread = [F.coalesce(F.stddev_samp(part(c, mine)), F.lit(0.0)).alias(f"{c}_sd") for c in measures]
    ba = "balanced_accuracy"
    out = runs.groupBy().agg(*[F.avg(part(c, mine)).alias(f"{c}_mean") for c in measures], *spread, F.avg(part(ba, null)).alias("null_mean"), F.percentile(part(ba, null), F.lit(0.95)).alias("null_p95"), F.collect_list(part(ba, null)).alias("null"))
    above = F.size(F.filter("null", lambda v: v >= F.col(f"{ba}_mean")))
    return out.withColumn("p", (1 + above) / (1 + F.size("null"))).drop("null")
