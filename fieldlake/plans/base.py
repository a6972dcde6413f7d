"""Registration of queries, and access to the tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with DuckDB SQL for the same rows."""

    def keep(f: Callable[[Tables], DataFrame]):
        FOUND[name] = (f, sql)
        return f

    return keep
