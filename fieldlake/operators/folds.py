"""Folds, balanced models over folds, and out-of-fold predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """df with fold: within each label, rows in a seeded order are dealt round."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("fold", (turn - 1) % k)


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0, most_groups: int = 100_000) -> DataFrame:
    """df with fold: a group lies in one fold, and labels are spread evenly.

    Groups with the most uneven labels come first; each goes where the folds'
    shares of all labels then differ least. Only a row per group and label
    reaches the driver, and more than most_groups groups are an error.
    """
    cells = df.groupBy(group, label).agg(F.count("*").alias("n"))
    found = cells.select(group).distinct().limit(most_groups + 1).count()
    if found > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    rows = cells.collect()
    labels = sorted({r[label] for r in rows}, key=str)
    names = sorted({r[group] for r in rows}, key=str)
    counts = np.zeros((len(names), len(labels)))
    where, column = {g: i for i, g in enumerate(names)}, {x: i for i, x in enumerate(labels)}
    for r in rows:
        counts[where[r[group]], column[r[label]]] = r["n"]
    total = np.maximum(1, counts.sum(axis=0))
    shuffled = np.random.default_rng(seed).permutation(len(names))
    order = shuffled[np.argsort(-counts[shuffled].std(axis=1), kind="stable")]
    held, size, fold = np.zeros((k, len(labels))), np.zeros(k), {}
    for g in order.tolist():
        cost = []
        for f in range(k):
            share = held.copy()
            share[f] += counts[g]
            cost.append((round(float((share / total).std(axis=0).mean()), 12), size[f], f))
        best = min(cost)[2]
        held[best] += counts[g]
        size[best] += counts[g].sum()
        fold[names[g]] = best
    placed = df.sparkSession.createDataFrame(list(fold.items()), T.StructType([cells.schema[group], T.StructField("fold", T.IntegerType())]))
    return df.join(placed, group)


def feasible_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0, tries: int = 100) -> tuple[DataFrame, int]:
    """Group folds from the first seed whose training parts all hold every label, and that seed; an error if there is none."""
    labels = df.select(label).distinct().count()
    for s in range(seed, seed + tries):
        folds = group_folds(df, group, label, k, s)
        cells = folds.groupBy(label).agg(F.count_distinct("fold").alias("folds"), F.min("fold").alias("only"))
        if labels and not cells.where("folds < 2").head(1):
            return folds, s
    raise ValueError(f"no seed of {tries} leaves every label in every training part")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weight: rows / (labels * rows of the label)."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    share = n.crossJoin(n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__labels")))
    return df.join(share.select(label, (F.col("__all") / (F.col("__labels") * F.col("__n"))).alias("weight")), label)


def out_of_fold(df: DataFrame, key: str, features: list[str], label: str, k: int, model: str = "logistic", trees: int = 500, seed: int = 0) -> DataFrame:
    """key, label, fold, score (of label 1) for two labels 0 and 1: each row from a model that has not seen its fold.

    Missing features become the training part's exact medians. Models weigh
    labels equally: balanced logistic regression (standardised, L2), or a
    random forest with at least two rows to a leaf.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    out = None
    for fold in range(k):
        seen, held = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        filled = Imputer(strategy="median", relativeError=0.0, inputCols=features, outputCols=[f"__{c}" for c in features]).fit(seen)
        packed = VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="__raw")
        ready = lambda part: packed.transform(filled.transform(part))
        train = balanced(ready(seen), label)
        if model == "logistic":
            scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(train)
            fitted = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", regParam=1 / max(1, train.count()), standardization=False).fit(scale.transform(train))
            scored = fitted.transform(scale.transform(ready(held)))
        else:
            fitted = RandomForestClassifier(featuresCol="__raw", labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=2, seed=seed).fit(train)
            scored = fitted.transform(ready(held))
        part = scored.select(key, label, F.lit(fold).alias("fold"), vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.union(part)
    return out


def importances(df: DataFrame, features: list[str], label: str, trees: int = 500, seed: int = 0) -> DataFrame:
    """feature, importance of a forest over all rows; the importances sum to 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    names = [f"__{c}" for c in features]
    filled = Imputer(strategy="median", relativeError=0.0, inputCols=features, outputCols=names).fit(df).transform(df)
    train = balanced(VectorAssembler(inputCols=names, outputCol="__raw").transform(filled), label)
    fitted = RandomForestClassifier(featuresCol="__raw", labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=2, seed=seed).fit(train)
    return df.sparkSession.createDataFrame(list(zip(features, fitted.featureImportances.toArray().tolist())), "feature string, importance double")
