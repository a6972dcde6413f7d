"""Jobs in batches that can be stopped and started again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import manifest
from .release import Store, publish_json


def _contents(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and bytes of a batch's files."""
    files = manifest(spark, folder, "*.parquet").select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "length", "sha256")
    return hashlib.sha256(json.dumps(sorted(map(list, files.collect()))).encode()).hexdigest()


def resumable(todo: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], folder: str, contract: dict, batches: int, stats: Callable[[DataFrame], DataFrame] | None = None, stop_after: int | None = None) -> DataFrame:
    """Apply work to todo in batches by a hash of key, and return all results; batches that are done are not done again.

    folder/contract.json holds the contract with the number of batches; another
    contract is an error. A batch counts once folder/commits has its rows and
    digest, and its bytes are checked when the job starts again; a changed batch
    is an error. A batch without a commit goes to folder/quarantine. stats gives
    key and the sources' sizes and times for a batch; they are taken before and
    after the work, and a change fails the batch. stop_after ends a run early,
    after so many batches.
    """
    spark, folder = todo.sparkSession, folder.rstrip("/")
    store = Store(spark, folder)
    store.mkdirs(folder)
    agreed = {"contract": contract, "batches": batches, "key": key}
    if store.exists(f"{folder}/contract.json"):
        if json.loads(store.read(f"{folder}/contract.json")) != agreed:
            raise ValueError("the folder belongs to another contract")
    else:
        publish_json(spark, f"{folder}/contract.json", agreed)
    store.mkdirs(f"{folder}/commits")
    store.mkdirs(f"{folder}/quarantine")
    done = {int(n[:-5]): json.loads(store.read(f"{folder}/commits/{n}")) for n in store.names(f"{folder}/commits") if n.endswith(".json") and n[0] != "."}
    for name in store.names(f"{folder}/batches"):
        if int(name) not in done:
            held = len(store.names(f"{folder}/quarantine"))
            store.move(f"{folder}/batches/{name}", f"{folder}/quarantine/{held:05d}-{name}")
    for n, commit in done.items():
        if _contents(spark, f"{folder}/batches/{n:05d}") != commit["sha256"]:
            raise ValueError(f"batch {n} has changed since its commit")
    store.mkdirs(f"{folder}/batches")
    made = 0
    for n in range(batches):
        if n in done:
            continue
        if stop_after is not None and made == stop_after:
            break
        part = todo.where(F.pmod(F.xxhash64(key), F.lit(batches)) == n)
        place = f"{folder}/batches/{n:05d}"
        if stats is None:
            work(part).write.mode("errorifexists").parquet(place)
        else:
            before = f"{folder}/stats/{n:05d}"
            stats(part).write.mode("overwrite").parquet(before)
            work(part).write.mode("errorifexists").parquet(place)
            old, new = spark.read.parquet(before), stats(part)
            if old.exceptAll(new).head(1) or new.exceptAll(old).head(1):
                raise ValueError(f"sources of batch {n} changed under the work")
        done[n] = {"rows": spark.read.parquet(place).count(), "sha256": _contents(spark, place)}
        publish_json(spark, f"{folder}/commits/{n:05d}.json", done[n])
        made += 1
        publish_json(spark, f"{folder}/progress.json", {"done": len(done), "batches": batches, "rows": sum(x["rows"] for x in done.values())}, "replace")
    if not done:
        return work(todo.limit(0))
    return spark.read.parquet(*[f"{folder}/batches/{n:05d}" for n in sorted(done)])
