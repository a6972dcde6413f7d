"""Writers of releases and resumable jobs."""

import gzip
import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_publish(spark, tmp_path):
    from fieldlake.sources import release as R

    place = str(tmp_path / "a.json")
    first = R.publish_json(spark, place, {"b": 1, "a": "é"})
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": "é", "b": 1} and first == hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    with pytest.raises(FileExistsError):
        R.publish_json(spark, place, {})
    assert R.publish_json(spark, place, {"a": "é", "b": 1}, "same") == first
    with pytest.raises(FileExistsError):
        R.publish_json(spark, place, {"a": 2}, "same")
    R.publish_json(spark, place, {"a": 3}, "replace")
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": 3}
    with pytest.raises(ValueError):
        R.publish_json(spark, str(tmp_path / "b.json"), float("nan"))
    assert not [n for n in os.listdir(tmp_path) if "staged" in n and not n.endswith(".crc")] and not (tmp_path / "b.json").exists()


def test_csv_has_the_same_bytes(spark, tmp_path):
    from fieldlake.sources import release as R

    rows = [(i % 50, f'x,"{i}', None if i % 3 else i / 2) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    one = R.publish_csv(df, str(tmp_path / "one.csv.gz"), ["a"])
    two = R.publish_csv(df.repartition(7, F.rand(3)), str(tmp_path / "two.csv.gz"), ["a"])
    assert one == two
    got = gzip.decompress((tmp_path / "one.csv.gz").read_bytes()).decode().split("\n")
    assert got[0] == "a,b,c" and got[1] == '0,"x,""0",0.0' and len(got) == 402
    R.publish_csv(df.where("false"), str(tmp_path / "empty.csv.gz"), ["a"])
    assert gzip.decompress((tmp_path / "empty.csv.gz").read_bytes()) == b"a,b,c\n"


def test_swap(spark, tmp_path):
    from fieldlake.sources import release as R

    for name, n in (("new", 3), ("old", 2)):
        spark.range(n).write.parquet(str(tmp_path / name))
    R.swap_folder(spark, str(tmp_path / "new"), str(tmp_path / "old"))
    assert spark.read.parquet(str(tmp_path / "old")).count() == 3 and sorted(os.listdir(tmp_path)) == ["old"]
    with pytest.raises(FileNotFoundError):
        R.swap_folder(spark, str(tmp_path / "none"), str(tmp_path / "old"))
    assert spark.read.parquet(str(tmp_path / "old")).count() == 3


def test_copies(spark, tmp_path):
    from fieldlake.sources import release as R

    plan = []
    for k, data in enumerate([b"", b"x" * 3_000_000, b"abc", b"linked"]):
        (tmp_path / f"s{k}").write_bytes(data)
        plan.append((str(tmp_path / f"s{k}"), str(tmp_path / "out" / f"t{k}"), len(data), hashlib.sha256(data).hexdigest()))
    os.symlink(tmp_path / "s3", tmp_path / "link")
    plan[3] = (str(tmp_path / "link"), *plan[3][1:])
    plan.append((plan[2][0], str(tmp_path / "out" / "t4"), 3, "0" * 64))
    df = spark.createDataFrame(plan, "source string, target string, bytes long, sha256 string")
    status = lambda d: {r["target"][-2:]: r["status"] for r in d.collect()}
    assert status(R.verified_copies(df, str(tmp_path / "log1"), resume=False)) == {"t0": "written", "t1": "written", "t2": "written", "t3": "failed", "t4": "failed"}
    assert sorted(os.listdir(tmp_path / "out")) == ["t0", "t1", "t2"] and (tmp_path / "out" / "t1").read_bytes() == b"x" * 3_000_000
    (tmp_path / "out" / "t2").write_bytes(b"abd")
    assert status(R.verified_copies(df, str(tmp_path / "log2"))) == {"t0": "present", "t1": "present", "t2": "failed", "t3": "failed", "t4": "failed"}
    with pytest.raises(FileExistsError):
        R.verified_copies(df, str(tmp_path / "log3"), resume=False)
    with pytest.raises(ValueError):
        R.verified_copies(df.union(df), str(tmp_path / "log4"))


def test_wavs_matrix_and_reports(spark, tmp_path):
    from fieldlake.sources import release as R
    from fieldlake.sources.files import wav_files

    x = [float(v) for v in np.random.default_rng(0).normal(size=500).astype("f4")]
    clips = spark.createDataFrame([(str(tmp_path / "w" / "a.wav"), 48000, x), (str(tmp_path / "w" / "b.wav"), 48000, [])], "target string, rate int, samples array<double>")
    assert sorted(r["status"] for r in R.export_wavs(clips, str(tmp_path / "log")).collect()) == ["failed", "written"]
    assert [r["status"] for r in R.export_wavs(clips.where("size(samples) > 0"), str(tmp_path / "again")).collect()] == ["present"]
    (back,) = wav_files(spark, str(tmp_path / "w")).collect()
    assert back["samples"] == x and back["rate"] == 48000
    R.write_matrix(spark.createDataFrame([(2, 1.5, None), (1, 0.5, 2.0)], "id long, p double, q double"), "id", ["p", "q"], str(tmp_path / "m"))
    m = spark.read.parquet(str(tmp_path / "m"))
    assert R.feature_names(m) == ["p", "q"] and {r["id"]: r["vector"] for r in m.collect()} == {1: [0.5, 2.0], 2: [1.5, None]}
    R.provenance(spark, {"clips": str(tmp_path / "w")}, {}, {"by": "test"}, str(tmp_path / "p.json"))
    doc = json.loads((tmp_path / "p.json").read_text())
    assert doc["inputs"]["clips"][0]["path"] == "a.wav" and doc["inputs"]["clips"][0]["sha256"] == hashlib.sha256((tmp_path / "w" / "a.wav").read_bytes()).hexdigest()
    text = R.markdown("T", [("S", spark.createDataFrame([("a|b", None)], "x string, y long")), ("E", m.where("false"))])
    assert "| a\\|b |  |" in text and "No rows." in text
    with pytest.raises(ValueError):
        R.markdown("T", [("S", spark.range(5))], most_rows=4)


def test_resumable(spark, tmp_path):
    from fieldlake.sources.jobs import resumable

    folder, todo = str(tmp_path / "job"), spark.range(100).withColumnRenamed("id", "k")
    work = lambda d: d.withColumn("v", F.col("k") * 2)
    run = lambda **more: resumable(todo, "k", work, folder, {"v": 1}, 4, **more)
    assert run(stop_after=0).count() == 0
    assert 0 < run(stop_after=2).count() < 100
    spark.range(1).write.parquet(f"{folder}/batches/00003")
    kept = os.stat(f"{folder}/batches/00000").st_mtime_ns
    got = run()
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(i, 2 * i) for i in range(100)]
    assert os.listdir(f"{folder}/quarantine") == ["00000-00003"] and os.stat(f"{folder}/batches/00000").st_mtime_ns == kept
    assert json.loads(open(f"{folder}/progress.json").read()) == {"done": 4, "batches": 4, "rows": 100}
    with pytest.raises(ValueError, match="contract"):
        resumable(todo, "k", work, folder, {"v": 2}, 4)
    work(todo.limit(3)).write.mode("overwrite").parquet(f"{folder}/batches/00001")
    with pytest.raises(ValueError, match="changed"):
        run()
    calls = []
    moving = lambda d: (calls.append(1), d.withColumn("size", F.lit(len(calls))))[1]
    with pytest.raises(ValueError, match="changed under"):
        resumable(todo, "k", work, str(tmp_path / "other"), {}, 2, stats=moving)
