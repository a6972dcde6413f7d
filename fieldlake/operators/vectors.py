"""Vector and label operators: element-wise medians, prototypes, distances, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def long_form(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """A row for each element: keys, i, v."""
    return df.select(*keys, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def medians(long: DataFrame, *keys: str) -> DataFrame:
    """The exact median of each element for each key."""
    return long.groupBy(*keys, "i").agg(F.percentile("v", 0.5).alias("v"))


def assembled(long: DataFrame, *keys: str) -> DataFrame:
    """keys, vector: elements put together again in order."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))


def source_units(df: DataFrame, vector: str, label: str, source: str) -> DataFrame:
    """One vector for each label and source: the medians of its rows."""
    return medians(long_form(df, vector, label, source), label, source)


def prototypes(df: DataFrame, vector: str, label: str, source: str) -> DataFrame:
    """One vector for each label: the medians of its sources' medians, so that no source weighs more than another."""
    return medians(source_units(df, vector, label, source), label)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """ari and nmi (arithmetic mean) of a contingency table, in one row."""
    pairs = lambda n: n * (n - 1) / 2
    entropy = lambda t: -F.sum(F.col(t) / F.col("total") * F.log(F.col(t) / F.col("total")))
    total = cells.agg(F.sum("n").alias("total"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    full = cells.join(rows, "a").join(columns, "b").crossJoin(total)
    p = F.col("n") / F.col("total")
    main = full.agg(F.sum(pairs(F.col("n"))).alias("sij"), F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"), F.max("total").alias("t"))
    ra = rows.crossJoin(total).agg(F.sum(pairs(F.col("na"))).alias("sa"), entropy("na").alias("ha"))
    cb = columns.crossJoin(total).agg(F.sum(pairs(F.col("nb"))).alias("sb"), entropy("nb").alias("hb"))
    one = main.crossJoin(ra).crossJoin(cb)
    chance = F.col("sa") * F.col("sb") / pairs(F.col("t"))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(most == chance, 1.0).otherwise((F.col("sij") - chance) / (most - chance))
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(ari.alias("ari"), F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))
