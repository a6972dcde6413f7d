"""Writers of releases: staged files and folders, verified copies, WAV exports, matrices, provenance and reports.

Small documents are written by the driver through Hadoop's file systems. Files
in number are written by executors through pyarrow's, so that the targets must
be in a store that pyarrow knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import manifest

CHUNK = 1 << 20
OUTCOME = "target string, bytes long, sha256 string, status string, error string"


class Store:
    """Files and folders of any file system that Spark knows, by path, from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._spark = spark
        self._fs = self.path(path).getFileSystem(self._conf)

    def path(self, name: str):
        return self._hadoop.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def mkdirs(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def move(self, source: str, target: str, replace: bool = False) -> None:
        """A rename; an existing target is an error unless it is to be replaced."""
        kind = getattr(self._hadoop, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        place = self._fs.makeQualified(self.path(target))
        self._hadoop.FileContext.getFileContext(place.toUri(), self._conf).rename(self._fs.makeQualified(self.path(source)), place, how)

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def digest(self, name: str) -> str:
        """SHA-256 of a file, read in chunks."""
        seen, stream = hashlib.sha256(), self._fs.open(self.path(name))
        try:
            while part := bytes(stream.readNBytes(CHUNK)):
                seen.update(part)
        finally:
            stream.close()
        return seen.hexdigest()

    def write(self, name: str, parts: Iterator[bytes]) -> str:
        """A new file from parts, flushed to disk; its SHA-256."""
        seen, stream = hashlib.sha256(), self._fs.create(self.path(name), False)
        try:
            for part in parts:
                seen.update(part)
                stream.write(bytearray(part))
            stream.hsync()
        finally:
            stream.close()
        return seen.hexdigest()


def publish(spark: SparkSession, path: str, parts: Iterator[bytes], mode: str = "new") -> str:
    """Write a file beside its place and move it there, whole or not at all; its SHA-256.

    An existing file: `new` raises FileExistsError, `same` keeps it if its bytes
    are the same and raises FileExistsError if not, `replace` replaces it.
    """
    if mode not in ("new", "same", "replace"):
        raise ValueError(f"unknown mode {mode}")
    store = Store(spark, path)
    if mode == "new" and store.exists(path):
        raise FileExistsError(path)
    folder, _, name = path.rpartition("/")
    staged = f"{folder}/.{name}.{uuid.uuid4().hex}.staged" if folder else f".{name}.{uuid.uuid4().hex}.staged"
    try:
        digest = store.write(staged, parts)
        if mode == "same" and store.exists(path):
            if store.digest(path) != digest:
                raise FileExistsError(f"{path} has other bytes")
            return digest
        store.move(staged, path, mode == "replace")
    finally:
        if store.exists(staged):
            store.delete(staged)
    return digest


def publish_json(spark: SparkSession, path: str, value: object, mode: str = "new") -> str:
    """A JSON document with sorted keys; NaN is an error."""
    return publish(spark, path, iter([(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n").encode()]), mode)


def publish_csv(df: DataFrame, path: str, order: list[str], mode: str = "new") -> str:
    """One gzip CSV with a header, the same bytes for the same rows; nulls are empty cells.

    order must determine the order of the rows; the other columns follow as
    tie-breakers. Rows pass the driver one partition at a time.
    """
    import csv

    rest = [c for c in df.columns if c not in order]
    rows = df.select(*[F.col(c).cast("string") for c in df.columns]) if not order else df.orderBy(*order, *rest).select(*[F.col(c).cast("string") for c in df.columns])

    def parts() -> Iterator[bytes]:
        raw = io.BytesIO()
        packed = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0)
        text = io.StringIO(newline="")
        out = csv.writer(text, lineterminator="\n")
        out.writerow(df.columns)
        for row in rows.toLocalIterator():
            out.writerow(["" if x is None else x for x in row])
            if text.tell() > CHUNK:
                packed.write(text.getvalue().encode())
                text.seek(0)
                text.truncate()
                if raw.tell():
                    yield raw.getvalue()
                    raw.seek(0)
                    raw.truncate()
        packed.write(text.getvalue().encode())
        packed.close()
        yield raw.getvalue()

    return publish(df.sparkSession, path, parts(), mode)


def swap_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Put a staged folder in the target's place; if that fails, the old folder is put back."""
    store = Store(spark, target)
    if not store.exists(staged):
        raise FileNotFoundError(staged)
    backup = f"{target.rstrip('/')}.{uuid.uuid4().hex}.backup"
    old = store.exists(target)
    if old:
        store.move(target, backup)
    try:
        store.move(staged, target)
    except Exception:
        if old:
            store.move(backup, target)
        raise
    if old:
        store.delete(backup)


def _place(uri: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if isinstance(system, fs.LocalFileSystem) and os.path.islink(name):
        raise ValueError("a link")
    return system, name


def _digest(system, name: str) -> tuple[int, str]:
    seen, n = hashlib.sha256(), 0
    with system.open_input_stream(name) as stream:
        while part := stream.read(CHUNK):
            seen.update(part)
            n += len(part)
    return n, seen.hexdigest()


def _put(target: str, parts: Iterator[bytes], want: tuple[int, str] | None, resume: bool) -> tuple:
    """Write parts to target by a staged file, reread and moved; a target with the wanted bytes stays if resume is set."""
    from pyarrow import fs

    system, name = _place(target)
    found = system.get_file_info(name).type != fs.FileType.NotFound
    if found and not resume:
        raise FileExistsError(target)
    if found and want is not None:
        if _digest(system, name) != want:
            raise FileExistsError(f"{target} has other bytes")
        return (target, *want, "present", None)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    staged = f"{folder}/.{last}.{uuid.uuid4().hex}.staged"
    try:
        with system.open_output_stream(staged, compression=None) as out:
            for part in parts:
                out.write(part)
        got = _digest(system, staged)
        if want is not None and got != want:
            raise ValueError("size or digest differs from the plan")
        if found:
            if _digest(system, name) != got:
                raise FileExistsError(f"{target} has other bytes")
            return (target, *got, "present", None)
        system.move(staged, name)
    finally:
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_file(staged)
    return (target, *got, "written", None)


def _outcomes(df: DataFrame, log: str, one) -> DataFrame:
    """Apply one to each row on the executors and keep the outcomes under log; a failure is a row with its error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for row in part.itertuples(index=False):
                try:
                    rows.append(one(row))
                except Exception as e:
                    rows.append((row.target, None, None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["target", "bytes", "sha256", "status", "error"]).astype({"bytes": "Int64"})

    df.mapInPandas(work, OUTCOME).write.mode("errorifexists").parquet(log)
    return df.sparkSession.read.parquet(log)


def verified_copies(plan: DataFrame, log: str, resume: bool = True) -> DataFrame:
    """Copy files by a plan of source, target, bytes, sha256 on the executors; outcomes by target.

    Bytes go in chunks to a staged file, which is reread, compared with the
    plan, and moved. Links fail. An existing target with the planned bytes
    counts as present, so that a task that runs again does no harm; without
    resume the plan's targets must not exist when the copying starts.
    """
    if plan.groupBy("target").count().where("count > 1").head(1):
        raise ValueError("a target occurs twice")
    if not resume:
        _refuse_existing(plan)

    def one(row) -> tuple:
        system, name = _place(row.source)
        want = (int(row.bytes), row.sha256)
        if _digest(system, name) != want:
            raise ValueError("the source differs from the plan")

        def parts() -> Iterator[bytes]:
            with system.open_input_stream(name) as stream:
                while part := stream.read(CHUNK):
                    yield part

        return _put(row.target, parts(), want, True)

    return _outcomes(plan.select("source", "target", "bytes", "sha256"), log, one)


def _refuse_existing(plan: DataFrame) -> None:
    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in batches:
            found = []
            for target in part["target"]:
                system, name = _place(target)
                found.append(system.get_file_info(name).type != fs.FileType.NotFound)
            yield part[np.array(found, dtype=bool)]

    if hit := plan.select("target").mapInPandas(present, "target string").head(1):
        raise FileExistsError(hit[0]["target"])


def float_wav(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """RIFF with 32-bit float samples."""
    data = np.asarray(samples, "<f4").tobytes()
    head = struct.pack("<HHIIHH", 3, channels, rate, rate * channels * 4, channels * 4, 32)
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, len(data) // (4 * channels)) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def export_wavs(clips: DataFrame, log: str) -> DataFrame:
    """Float WAV files from rows of target, rate, samples; outcomes by target. A clip without samples fails."""

    def one(row) -> tuple:
        if row.samples is None or not len(row.samples):
            raise ValueError("no samples")
        return _put(row.target, iter([float_wav(row.samples, int(row.rate))]), None, True)

    return _outcomes(clips.select("target", "rate", "samples"), log, one)


def write_matrix(df: DataFrame, key: str, features: list[str], path: str) -> None:
    """key, vector as Parquet, ordered by key; the feature names are the vector's metadata."""
    vector = F.array(*[F.col(c).cast("float") for c in features]).alias("vector", metadata={"feature_names": features})
    df.select(key, vector).orderBy(key).write.mode("errorifexists").parquet(path)


def feature_names(matrix: DataFrame) -> list[str]:
    return matrix.schema["vector"].metadata["feature_names"]


def provenance(spark: SparkSession, inputs: dict[str, str], outputs: dict[str, str], facts: dict, path: str, mode: str = "new", most_files: int = 100_000) -> str:
    """A JSON document of facts, and of bytes and SHA-256 of all files below the named inputs and outputs.

    More than most_files files are an error: their digests belong in a table.
    """
    out: dict = {"facts": facts, "inputs": {}, "outputs": {}}
    for kind, places in (("inputs", inputs), ("outputs", outputs)):
        for name, root in sorted(places.items()):
            rows = manifest(spark, root).limit(most_files + 1).collect()
            if len(rows) > most_files:
                raise ValueError(f"more than {most_files} files in {name}")
            out[kind][name] = [{"path": r["path"].rsplit("/", 1)[-1] if len(rows) == 1 else r["path"].split(root.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1], "bytes": r["length"], "sha256": r["sha256"]} for r in rows]
    return publish_json(spark, path, out, mode)


def markdown(title: str, sections: list[tuple[str, DataFrame]], most_rows: int = 1_000) -> str:
    """A report of small tables; a table with more than most_rows rows is an error."""
    cell = lambda x: "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", ""]
    for heading, df in sections:
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{heading} has more than {most_rows} rows")
        out += [f"## {heading}", ""]
        if rows:
            out += ["| " + " | ".join(map(cell, df.columns)) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
            out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
        else:
            out.append("No rows.")
        out.append("")
    return "\n".join(out)
