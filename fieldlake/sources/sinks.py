"""Write-once and verified sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, separator: str = ",") -> None:
    """Text files with a header; an existing folder is an error, and an empty table is allowed."""
    df.write.mode("errorifexists").option("header", True).option("sep", separator).option("compression", "gzip").csv(path)


def partitioned_export(df: DataFrame, path: str, by: str, order: str) -> None:
    """One folder for each value of by, rows in numeric order inside."""
    df.repartition(F.col(by)).sortWithinPartitions(by, F.col(order).cast("int")).write.mode("errorifexists").option("header", True).option("sep", "\t").partitionBy(by).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table does not hold yet; the number appended."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df = df.dropDuplicates([key])
    before = df.count()
    df.write.mode("append").parquet(path)
    return before
