"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (a minimum for each node, combined before the
shuffle) and one equi-join, so that a hub with any number of neighbours is
split like any other skewed join key. No edge is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b: every node's wanted neighbours point at the least of them and itself."""
    if large:  # all neighbours of a node; the greater ones move
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # lesser neighbours only; these and the node move
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node that has a link; component is the smallest id reachable.

    edges: two long columns a and b. Null ends and loops are ignored. The loop
    ends when a round changes nothing, after a number of rounds that grows
    with the logarithm of the longest chain.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    before = digest(now)
    while before["n"]:
        after = scratch.save(_star(_star(now, large=True), large=False))
        scratch.drop(now)
        now, found = after, digest(after)
        if found == before:
            break
        before = found
    ends = now.groupBy("a").agg(F.min("b").alias("component"))
    return ends.select(F.col("a").alias("id"), "component").union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
