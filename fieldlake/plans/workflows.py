"""Queries over files and random draws; these have no SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import Tables, query


@query("manifest_build")
def manifest_build(t: Tables):
    """Path, bytes and SHA-256 of the files of one table, by path."""
    from ..sources.files import manifest

    return manifest(t.spark, f"{t.folder}/benchmark.parquet").withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))


@query("provenance")
def provenance(t: Tables):
    """A digest of each small input table's files."""
    from ..sources.files import manifest

    names = ("region", "nation", "benchmark")
    out = None
    for n in names:
        one = manifest(t.spark, f"{t.folder}/{n}.parquet").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("digest")).select(F.lit(n).alias("name"), "*")
        out = one if out is None else out.union(one)
    return out


@query("raven_export", "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as selection, 'Waveform 1' as view, 1 as channel, printf('%.3f', l_discount) as begin_s, printf('%.3f', l_discount + l_tax) as end_s from lineitem")
def raven_export(t: Tables):
    """Selection tables, numbered from 1 in each file."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t.lineitem.select("l_orderkey", n.cast("long").alias("selection"), F.lit("Waveform 1").alias("view"), F.lit(1).alias("channel"), F.format_string("%.3f", "l_discount").alias("begin_s"), F.format_string("%.3f", F.col("l_discount") + F.col("l_tax")).alias("end_s"))


@query("raven_read", "select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as global_id from lineitem where l_tax > 0")
def raven_read(t: Tables):
    """Rows with a positive length, numbered densely: places come from each range partition's count, not from one sorted task."""
    from ..operators.numbering import dense_number

    rows = t.lineitem.where("l_tax > 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dense_number(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "global_id").select("l_orderkey", "l_linenumber", "global_id")


@query("bootstrap_ci")
def bootstrap_ci(t: Tables):
    """A 95 % interval of each label's mean length, from Poisson weights for each of 200 draws: one pass, no resampled table."""
    draws = 200
    length = t.documents.where("n_chars is not null").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"))
    weights = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda k: F.pmod(F.xxhash64("lang", "source", k), F.lit(1000)) / 1000)
    poisson = lambda u: F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.9810, 3).otherwise(4)
    rows = length.select("lang", "m", F.posexplode(weights).alias("draw", "u")).withColumn("w", poisson(F.col("u")))
    means = rows.groupBy("lang", "draw").agg((F.sum(F.col("w") * F.col("m")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    return means.groupBy("lang").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.5).alias("middle"), F.percentile("mean", 0.975).alias("high"))
