"""Scaling, comparison and review operators over plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, value: str, by: list[str], robust: bool = False, name: str = "scaled") -> DataFrame:
    """df with value less its group's mean over the population's deviation, or less the median over the exact interquartile range.

    A spread of 0 counts as 1. The statistics are one row for each group and
    come back by an equi-join, so that a large group is no window of one task.
    """
    if robust:
        centre, spread = F.percentile(value, 0.5), F.percentile(value, 0.75) - F.percentile(value, 0.25)
    else:
        centre, spread = F.avg(value), F.stddev_pop(value)
    own = df.groupBy(*by).agg(centre.alias("__centre"), spread.alias("__spread"))
    spread = F.when(F.col("__spread") == 0, 1.0).otherwise(F.col("__spread"))
    return df.join(own, by).withColumn(name, (F.col(value) - F.col("__centre")) / spread).drop("__centre", "__spread")


def components(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, i (from 0), v: a row for each component of each vector."""
    return df.select(key, F.posexplode(vector).alias("i", "v"))


def principal(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """(key and `scores`, the k principal scores of each centred vector; the k components' shares of the variance). Vectors have one length, and its square fits the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    model = PCA(k=k, inputCol="__v", outputCol="__s").fit(rows)
    return model.transform(rows).select(key, vector_to_array("__s").alias("scores")), [float(x) for x in model.explainedVariance]


def within_tolerance(a: Column, b: Column, relative: float, absolute: float) -> Column:
    """Whether a and b differ by at most the larger of both tolerances; two nulls agree, a null and a number don't."""
    near = F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def compared(actual: DataFrame, expected: DataFrame, path: str, value: str, relative: float = 1e-10, absolute: float = 1e-8) -> DataFrame:
    """path, actual, expected, difference, agrees of two flat documents of numbers; a path that only one side has does not agree."""
    a, b = actual.select(path, F.col(value).alias("actual"), F.lit(True).alias("__a")), expected.select(path, F.col(value).alias("expected"), F.lit(True).alias("__b"))
    both = a.join(b, path, "full")
    there = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.select(path, "actual", "expected", F.abs(F.col("actual") - F.col("expected")).alias("difference"), (there & within_tolerance(F.col("actual"), F.col("expected"), relative, absolute)).alias("agrees"))


def payload_kind(size: str) -> Column:
    """Of a group: empty if all sizes are 0, nonempty if all are above 0, unverified if they differ or one isn't known."""
    return F.when(F.bool_and(F.coalesce(F.col(size) == 0, F.lit(False))), "empty").when(F.bool_and(F.coalesce(F.col(size) > 0, F.lit(False))), "nonempty").otherwise("unverified")


def truth(value: str) -> Column:
    """true, 1 and yes in any case, with white space around."""
    return F.lower(F.trim(F.col(value).cast("string"))).isin("true", "1", "yes")


def utc_seconds(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO time that states its offset; null for one that doesn't."""
    return F.when(stamp.rlike(r"([+-]\d\d:\d\d|Z)$"), F.unix_seconds(F.try_to_timestamp(stamp)))


def canonical_json(values: dict[str, str]) -> Column:
    """A JSON object of columns by key, keys in order, ", " and ": " between them, null for null."""
    parts = []
    for key in sorted(values):
        text = F.to_json(F.struct(F.col(values[key]).alias("v")))  # {"v":...}
        parts.append(F.concat(F.lit(f'"{key}": '), F.when(F.col(values[key]).isNull(), "null").otherwise(F.regexp_extract(text, r'(?s)^\{"v":(.*)\}$', 1))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


#: What a review does to a member, and to a row that is none.
OUTCOMES = {"add": ("already_member", "added"), "remove": ("removed", "already_absent"), "defer": ("deferred_member", "deferred_candidate")}


def reviewed(reviews: DataFrame, key: str, order: list[str], decision: str, base: str, known: str) -> DataFrame:
    """reviews with `member_before` and `outcome`, one of nine; each review sees what the ones before it left.

    decision is add, remove or defer; base is the membership before all
    reviews; a row whose `known` is false matches nothing. Membership after any
    prefix is the last add or remove in it, so that no review waits for another.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col(known) & (F.col(decision) == "add"), True).when(F.col(known) & (F.col(decision) == "remove"), False)
    out = reviews.withColumn("__step", step).withColumn("member_before", F.coalesce(F.last("__step", ignorenulls=True).over(before), F.col(base))).drop("__step")
    outcome = F.when(~F.col(known), "unmatched").when(F.col(decision).isNull(), "missing_decision")
    for name, (member, other) in OUTCOMES.items():
        outcome = outcome.when(F.col(decision) == name, F.when(F.col("member_before"), member).otherwise(other))
    return out.withColumn("outcome", outcome.otherwise("invalid_decision"))
