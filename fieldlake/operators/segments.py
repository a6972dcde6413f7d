"""Bouts: segments of a source that follow each other within a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_bouts(segments: DataFrame, source: str, onset: str, offset: str, tie: str, gap: float) -> DataFrame:
    """segments with bout: a new one starts where the onset is more than gap after the offset of the row before it (not of the latest offset so far)."""
    w = Window.partitionBy(source).orderBy(onset, tie)
    fresh = F.when(F.lag(offset).over(w).isNull() | (F.col(onset) - F.lag(offset).over(w) > gap), 1).otherwise(0)
    return segments.withColumn("__fresh", fresh).withColumn("bout", F.sum("__fresh").over(w)).drop("__fresh")


def bout_summary(numbered: DataFrame, source: str, onset: str, offset: str) -> DataFrame:
    """source, bout, n, duration (first onset to last offset), active (sum of the segments' own lengths)."""
    return numbered.groupBy(source, "bout").agg(
        F.count("*").alias("n"),
        (F.max_by(offset, F.struct(onset, offset)) - F.min(onset)).alias("duration"),
        F.sum(F.col(offset) - F.col(onset)).alias("active"),
    )


def longest_bouts(summary: DataFrame, source: str) -> DataFrame:
    """Per source: bouts, segments, active time, and the bout with most segments (the first one on ties)."""
    best = F.max(F.struct("n", -F.col("bout"), "duration"))
    return summary.groupBy(source).agg(F.count("*").alias("bouts"), F.sum("n").alias("segments"), F.sum("active").alias("active"), best.alias("b")).select(source, "bouts", "segments", "active", F.col("b.n").alias("longest_n"), F.col("b.duration").alias("longest_duration"))
