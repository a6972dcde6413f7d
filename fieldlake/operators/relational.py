"""Relational operators with stated rules: picks, diffs, grids, samples, constraints.

Each returns a DataFrame; constraints return their violations, so that an empty
result is a pass and nothing is raised in the middle of a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def occurrence(df: DataFrame, keys: list[str], order: list, name: str = "occurrence") -> DataFrame:
    """df with each row's place among the rows with equal keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def equidistant(df: DataFrame, strata: list[str], order: list, k: int) -> DataFrame:
    """k rows of each stratum at even distances, ends included; small strata whole, and the middle row for k = 1."""
    rows = df.withColumn("__i", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*strata)))
    if k == 1:
        wanted = F.col("__i") == F.floor(F.col("__n") / 2)
    else:
        wanted = (F.col("__n") <= k) | F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (k - 1)).cast("int")), F.col("__i"))
    return rows.where(wanted).drop("__i", "__n")


def smallest_by_hash(df: DataFrame, strata: list[str], key: Column, k: int) -> DataFrame:
    """The k rows of each stratum with the smallest key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("__n") <= k).drop("__n")


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (new, missing, changed, same) of two inventories."""
    a, b = old.select(key, F.col(value).alias("__old"), F.lit(True).alias("__a")), new.select(key, F.col(value).alias("__new"), F.lit(True).alias("__b"))
    status = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "missing").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def dense_grid(facts: DataFrame, dimensions: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Every combination of the dimension lists (a few values each) with the facts' measures, 0 where there are none."""
    grid = dimensions[0]
    for d in dimensions[1:]:
        grid = grid.crossJoin(d)
    return grid.join(facts, keys, "left").fillna(0, measures)


def broken_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key is not among the parent's."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: how many rows break each rule (a null outcome breaks it), in one pass."""
    sums = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.rule", "x.violations")


def jaccard_by_pairs(df: DataFrame, group: str, item: str, *within: str) -> DataFrame:
    """Pairs of groups a < b that share an item, by the items that they share: within, a, b, both, either, jaccard. Pairs that share none have no row."""
    items = df.select(*within, group, item).distinct()
    sizes = items.groupBy(*within, group).agg(F.count("*").alias("n"))
    left, right = items.withColumnRenamed(group, "a"), items.withColumnRenamed(group, "b")
    both = left.join(right, [*within, item]).where("a < b").groupBy(*within, "a", "b").agg(F.count("*").alias("both"))
    both = both.join(sizes.withColumnsRenamed({group: "a", "n": "na"}), [*within, "a"]).join(sizes.withColumnsRenamed({group: "b", "n": "nb"}), [*within, "b"])
    either = F.col("na") + F.col("nb") - F.col("both")
    return both.select(*within, "a", "b", "both", either.alias("either"), (F.col("both") / either).alias("jaccard"))
