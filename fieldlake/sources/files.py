"""File sources: inventories, manifests, checksum lists, typed text tables, WAV headers and samples.

Everything is read by Spark's readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of all files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, sha256 by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """sha256, path of a list of `digest  path` lines."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("sha256"), parts[1].alias("path"))


def text_table(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """A table with a header as text columns; empty cells are null. Gzip and a byte order mark are no matter."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("nullValue", "").option("enforceSchema", False).csv(path)


#: The detector's header.
DETECTOR = ("Start (s)", "End (s)", "Scientific name", "Common name", "Confidence")


def detector_rows(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Rows of all detector tables below root: path, line (in file order), the five text columns, malformed.

    A whole file is one row first, so that files without rows and the order of
    lines are kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    lines = files.select("path", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line", "value"))
    cells = F.split("value", ";")
    good = F.size(cells) == len(DETECTOR)
    return lines.where("value <> '' or line = 0").select("path", "line", "value", *[F.when(good, cells[k]).alias(c) for k, c in enumerate(("start", "end", "scientific", "common", "confidence"))], (~good).alias("malformed"))


def detector_audit(rows: DataFrame, target: str, duration: float = 30.0) -> DataFrame:
    """Per file: status (ok, empty, parse_error), rows, malformed, bad scores, target windows, duplicate and late windows, and the target's best score as its own text."""
    header = F.col("line") == 0
    name = F.regexp_replace("scientific", r"^\s+|\s+$", "")
    score = F.col("confidence").try_cast("decimal(38,30)")
    valid = score.isNotNull() & score.between(0, 1)
    ends = F.col("end").try_cast("double")
    mine = ~header & (name == target)
    window = F.when(mine, F.struct("start", "end"))
    out = rows.groupBy("path").agg(
        F.bool_or(header & (F.col("value") == ";".join(DETECTOR))).alias("header_ok"),
        F.count_if(~header).alias("n_rows"),
        F.count_if(~header & F.col("malformed")).alias("malformed"),
        F.count_if(~header & ~F.col("malformed") & ~F.coalesce(valid, F.lit(False))).alias("bad_scores"),
        F.count_if(mine).alias("targets"),
        (F.count(window) - F.count_distinct(window)).alias("duplicate_windows"),
        F.count_if(mine & (ends > duration)).alias("late_windows"),
        F.count_if(mine & (F.col("scientific") != name)).alias("trimmed"),
        F.max_by("confidence", F.when(mine & valid, F.struct(score.alias("s"), -F.col("line")))).alias("best"),
    )
    status = F.when(~F.col("header_ok") | (F.col("malformed") > 0) | (F.col("bad_scores") > 0), "parse_error").when(F.col("n_rows") == 0, "empty").otherwise("ok")
    return out.withColumn("status", status)


_WAV = T.StructType([T.StructField("path", T.StringType()), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("frames", T.LongType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def decode_wav(content: bytes) -> tuple:
    """(rate, channels, frames, interleaved float samples) of RIFF PCM (8, 16, 24, 32 bits) or 32-bit float."""
    import struct

    import numpy as np

    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data" and kind:
            code, channels, rate, _, _, bits = kind
            raw = content[at + 8 : at + 8 + size]
            if code == 3 and bits == 32:
                x = np.frombuffer(raw, "<f4")
            elif bits == 16:
                x = np.frombuffer(raw, "<i2").astype("f4") / 32768
            elif bits == 32:
                x = (np.frombuffer(raw, "<i4") / 2147483648).astype("f4")
            elif bits == 24:
                b = np.frombuffer(raw, "u1").reshape(-1, 3).astype("i4")
                x = (((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8) / 8388608).astype("f4")
            else:
                x = (np.frombuffer(raw, "u1").astype("f4") - 128) / 128
            return rate, channels, len(x) // channels, x
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_files(spark: SparkSession, root: str) -> DataFrame:
    """path, rate, channels, frames, samples, error of all WAV files; a file that can't be read is a row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows.append((path, *decode_wav(content), None))
                except Exception as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=_WAV.names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path", "content").mapInPandas(read, _WAV)
