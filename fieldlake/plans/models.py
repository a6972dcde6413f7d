"""Folds and models. A document's features are its length, label of toxicity and id's remainder; its group is its source and id's remainder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import folds as O
from .base import Tables, query

FEATURES = ["chars", "toxic", "turn"]


def labelled(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").where("quality is not null")
    return rows.select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("n_chars").cast("double").alias("chars"), F.col("toxic").cast("double").alias("toxic"), (F.col("doc_id") % 7).cast("double").alias("turn"), F.concat_ws("-", "source", (F.col("doc_id") % 11).cast("string")).alias("unit"))


@query("stratified_kfold")
def stratified_kfold(t: Tables):
    """Rows of each label and fold; within a label, folds differ by a row at most."""
    return O.stratified_folds(labelled(t), "doc_id", "quality", 5).groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query("group_kfold")
def group_kfold(t: Tables):
    """The fold of each group, from the first seed that leaves every label in every training part."""
    return O.feasible_folds(labelled(t), "unit", "quality", 5)[0].groupBy("unit", "fold").agg(F.count("*").alias("n"))


@query("logistic_oof")
def logistic_oof(t: Tables):
    """Out-of-fold scores of balanced logistic regression over group folds."""
    return O.out_of_fold(O.feasible_folds(labelled(t), "unit", "quality", 5)[0], "doc_id", FEATURES, "quality", 5)


@query("forest_importances")
def forest_importances(t: Tables):
    return O.importances(labelled(t), FEATURES, "quality")


@query("classification_evidence")
def classification_evidence(t: Tables):
    """Repeated group folds of a balanced multinomial model against permuted labels: one row."""
    rows = labelled(t).select("doc_id", "unit", F.col("quality").cast("string").alias("quality"), F.array(*FEATURES).alias("vector"))
    return E.summary(E.evidence(rows, "doc_id", "vector", "quality", "unit")[0])
