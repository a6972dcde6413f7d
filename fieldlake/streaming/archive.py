"""Continuous forms: completion markers to an idempotent archive, and stateful bouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MARKER = "schema_version int, completed boolean, recording_id string, wav string, csv string, wav_sha256 string, csv_sha256 string"


def markers(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New completion markers; only complete ones with both digests count, and never a file's age or size."""
    found = spark.readStream.schema(MARKER).option("maxFilesPerTrigger", files_per_batch).option("multiLine", True).json(folder)
    digest = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    status = F.when(F.coalesce(F.col("completed") & digest("wav_sha256") & digest("csv_sha256") & F.col("recording_id").isNotNull(), F.lit(False)), "ready").otherwise("error")
    return found.withColumn("status", status).withColumn("identity", F.sha2(F.concat_ws("|", "recording_id", "wav"), 256)).withColumn("content", F.sha2(F.concat_ws("|", "wav_sha256", "csv_sha256"), 256))


def archive(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each identity once to a Parquet table. The same marker again changes nothing; one with other contents fails the query.

    A batch that runs again after a failure finds its rows in the table, so
    that none is written twice.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ready = batch.where("status = 'ready'").dropDuplicates(["identity", "content"])
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(table).select("identity", F.col("content").alias("held"))
            both = ready.join(held, "identity", "left")
            if not both.where("held <> content").isEmpty():
                raise ValueError("a marker's contents differ from what is archived")
            ready = both.where("held is null").drop("held")
        if not ready.groupBy("identity").count().where("count > 1").isEmpty():
            raise ValueError("markers of one recording differ")
        ready.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bouts(stream: DataFrame, gap_us: int) -> DataFrame:
    """Closed bouts of a stream of (source string, onset long, offset long); a bout's state is four numbers.

    A bout closes when a segment starts more than the gap after the offset of
    the one before it. Within a batch, segments are taken in order of onset; a
    segment that comes later than that joins the open bout or closes it like
    any other. A source's last bout stays open.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, n, number = state.get if state.exists else (None, None, 0, 0)
        out = []
        for onset, offset in sorted((int(a), int(b)) for p in parts for a, b in zip(p["onset"], p["offset"])):
            if n and onset - last > gap_us:
                number += 1
                out.append((key[0], number, n, last - first))
                n = 0
            first, last, n = (onset if n == 0 else first), offset, n + 1
        state.update((first, last, n, number))
        yield pd.DataFrame(out, columns=["source", "bout", "n", "duration"])

    return stream.groupBy("source").applyInPandasWithState(update, "source string, bout long, n long, duration long", "first long, last long, n long, number long", "append", "NoTimeout")
