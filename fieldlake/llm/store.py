"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to a Python worker; one longer row is a batch of its own.
BATCH_BYTES = 16 << 20

#: Spark's setting by which an execution deletes its shuffles' files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset (a local session, as in tests), a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one operator call, as Parquet below the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks that
    were running, never the work before the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        """From here on, Python workers of the session get Arrow batches of about BATCH_BYTES, so that long rows fit in memory."""
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
            spark.conf.set(key, BATCH_BYTES)

    def save(self, df: DataFrame, hashes: bool = False) -> DataFrame:
        """Write and reread df. What its shuffles wrote is deleted with the end of the write: the table takes its place. hashes: most values occur once, so that dictionaries don't pay."""
        self.written += 1
        path = f"{self.folder}/{self.written:04d}"
        before = self.spark.conf.get(CLEAN)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._fieldlake_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._fieldlake_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, scratch: Scratch, name: str = "row") -> DataFrame:
    """docs with a key of each row, a struct (file, place): ids may be null or repeated, row keys may not.

    A row that comes straight from a file, through projections and filters,
    has the hash of its file's path and its place in the file, which stay the
    same whenever the table is read. All other rows are numbered and written;
    the same DataFrame gets the same keys again.
    """
    keyed = docs.__dict__.get("_fieldlake_keyed")
    if keyed is None:
        keyed = docs.__dict__["_fieldlake_keyed"] = _keyed(docs, scratch)
    return keyed if name == KEY else keyed.withColumn(name, F.col(KEY)).drop(KEY)


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            at = docs.metadataColumn("_metadata")
            out = docs.withColumn(KEY, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")))
            out.schema  # resolved here: a format without row places is known now
            return out
        except AnalysisException:
            pass
    return scratch.save(docs.withColumn(KEY, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("place"))))


#: The column of a row's key beside columns of any name.
KEY = "__row"

#: The type of a row's key, as DDL and for Arrow.
ROW = "struct<file:bigint,place:bigint>"
