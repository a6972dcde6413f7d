"""Library operators, sources, signal kernels and streaming on small fixtures, and all queries against their SQL."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_exact_decimals(spark):
    from fieldlake.functions.exprs import dec

    texts = ["0.50000000000000000000001", "0.5", "0.5000", "nan", "inf", "", " 0.7 ", "1e-1", "0." + "1" * 31, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(dec("x") > F.lit("0.5").cast("decimal(38,30)")).collect()]
    assert got == [True, False, False, None, None, None, True, False, None, None]


def test_file_names(spark):
    from fieldlake.plans.identity import identified

    names = ["2023-05-01-birdnet-04_05_06.mp3", "2023-02-30-birdnet-04_05_06.mp3", "2023-05-01-birdnet-24_05_06.mp3", "x.mp3"]
    rows = identified(spark.createDataFrame([("a", n) for n in names] + [("b", names[0])], "site string, f string"), F.lit(2023)).collect()
    assert [r["stamp"] for r in rows] == ["2023-05-01T04:05:06", None, None, None, "2023-05-01T04:05:06"] and len({r["logical"] for r in rows}) == 5


def test_detector_audit(spark, tmp_path):
    from fieldlake.sources.files import DETECTOR, detector_audit, detector_rows

    head = ";".join(DETECTOR)
    files = {"a": f"﻿{head}\n0;3;T;t;0.8\n0;3; T ;t;0.70\n28.5;31.5;T;t;0.80\n", "b": head, "c": f"{head}\n0;3;T;t;nan\n0;3;T;t;0.9\n", "d": f"{head}\n1;2;T;t;0.5;x\n", "e": "wrong\n"}
    for k, x in files.items():
        (tmp_path / f"{k}.csv").write_text(x)
    got = {r["path"][-5]: r for r in detector_audit(detector_rows(spark, str(tmp_path)), "T").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "empty", "c": "parse_error", "d": "parse_error", "e": "parse_error"}
    a = got["a"]
    assert (a["best"], a["targets"], a["duplicate_windows"], a["late_windows"], a["trimmed"]) == ("0.8", 3, 1, 1, 1) and got["c"]["best"] == "0.9"


def test_wav_manifest_and_checksums(spark, tmp_path):
    import wave

    from fieldlake.sources import files as S

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(48000)
        w.writeframes(np.array([0, 16384, -32768], dtype="<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"no")
    rows = {r["path"][-5:]: r for r in S.wav_files(spark, str(tmp_path)).collect()}
    assert rows["a.wav"]["samples"] == [0.0, 0.5, -1.0] and rows["a.wav"]["rate"] == 48000 and rows["b.wav"]["error"]
    (tmp_path / "sums.txt").write_text("ab  x y.wav\n\ncd  z.wav\n")
    assert [tuple(r) for r in S.checksum_list(spark, str(tmp_path / "sums.txt")).collect()] == [("ab", "x y.wav"), ("cd", "z.wav")]
    assert S.manifest(spark, str(tmp_path), "*.wav").count() == 2


def test_bouts_use_the_previous_offset(spark):
    from fieldlake.operators.segments import bout_summary, longest_bouts, numbered_bouts

    rows = [("a", 1, 0, 10), ("a", 2, 1, 2), ("a", 3, 6, 7), ("a", 4, 20, 21), ("b", 5, 0, 1)]
    df = spark.createDataFrame(rows, "s string, e long, a long, b long")
    got = {r["s"]: r for r in longest_bouts(bout_summary(numbered_bouts(df, "s", "a", "b", "e", 3), "s", "a", "b"), "s").collect()}
    assert (got["a"]["bouts"], got["a"]["longest_n"], got["a"]["longest_duration"]) == (3, 2, 2) and got["b"]["bouts"] == 1


def test_rank_ties_and_samples(spark):
    from fieldlake.functions.exprs import rank_pct
    from fieldlake.operators.numbering import dense_number
    from fieldlake.operators.relational import equidistant

    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3)], "g int, v int")
    assert sorted(r[0] for r in df.select(rank_pct(F.col("v"), "g")).collect()) == [0.25, 0.625, 0.625, 1.0]
    many = spark.range(20).select(F.lit(1).alias("g"), "id")
    assert sorted(r["id"] for r in equidistant(many, ["g"], ["id"], 5).collect()) == [0, 5, 10, 14, 19]
    assert [r["id"] for r in equidistant(many, ["g"], ["id"], 1).collect()] == [10]
    numbered = dense_number(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["x"], "n").collect()
    assert all(r["x"] == r["n"] for r in numbered)


def test_agreement_ignores_names(spark):
    from fieldlake.operators.vectors import agreement, contingency

    same = spark.createDataFrame([(0, 8), (0, 8), (1, 3), (1, 3)], "a int, b int")
    assert tuple(agreement(contingency(same, "a", "b")).first()) == pytest.approx((1.0, 1.0))


def test_prototypes(spark):
    from fieldlake.operators.vectors import prototypes, source_units

    rows = [("a", "r1", [0.0]), ("a", "r1", [2.0]), ("a", "r2", [10.0]), ("b", "r3", [20.0]), ("b", "r4", [22.0])]
    df = spark.createDataFrame(rows, "label string, source string, v array<double>")
    assert sorted(r["v"] for r in source_units(df, "v", "label", "source").collect()) == [1, 10, 20, 22]
    assert {r["label"]: r["v"] for r in prototypes(df, "v", "label", "source").collect()} == {"a": 5.5, "b": 21}


def test_spectrogram():
    from fieldlake.functions.signal import spectrogram

    silent = spectrogram(np.zeros(632), 48000)
    assert (silent["frames"], silent["last_stop"], silent["uncovered"]) == (2, 608, 24) and (silent["db"] == -70).all()
    x = np.random.default_rng(0).normal(size=4000)
    assert np.abs(spectrogram(x, 48000)["db"] - spectrogram(x / 2, 48000)["db"]).max() < 1e-10
    for bad, rate in ((x[:500], 48000), (x.reshape(2, -1), 48000), (np.full(600, np.nan), 48000), (x, 22050)):
        with pytest.raises(ValueError):
            spectrogram(bad, rate)


def test_pcm_statistics_do_not_depend_on_chunks():
    from fieldlake.functions.signal import PcmStatistics, framed

    mono = np.concatenate([np.zeros(250), np.ones(100), np.full(50, 1.5), -np.ones(100)]).astype("<f4")
    stereo = np.concatenate([np.zeros(113), np.full(122, 0.25), np.ones(12)])
    stereo = np.stack([stereo, -stereo], axis=1).astype("<f4")
    for data, channels, want in ((mono, 1, {"longest_zero": 250, "longest_constant": 250, "eq1": 200, "gt1": 50, "ge1": 250, "windows": 10}), (stereo, 2, {"longest_zero": 113, "longest_constant": 122, "windows": 5, "partial": 2})):
        results = []
        for size in (37, 8192, 262144):
            s, raw = PcmStatistics(channels, 1000), data.tobytes()
            for k in range(0, len(raw), size):
                s.feed(raw[k : k + size])
            results.append(s.result())
        assert all(results[0][k] == v for k, v in want.items()), results[0]
        assert all(r[k] == pytest.approx(v) for r in results for k, v in results[0].items())
    windows = framed(np.ones(1_440_000), 144_000, 72_000)
    assert windows.shape == (20, 144_000) and windows[-1, 72_000:].sum() == 0


def test_archive_is_idempotent(spark, tmp_path):
    from fieldlake.streaming import archive as A

    def publish(name, wav="a" * 64, rec="r1"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps({"schema_version": 1, "completed": True, "recording_id": rec, "wav": f"{rec}.wav", "csv": "c", "wav_sha256": wav, "csv_sha256": "b" * 64}))

    def run(check="check"):
        q = A.archive(A.markers(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / check))
        q.awaitTermination(120)

    publish("1.json")
    publish("2.json", rec="r2")
    (tmp_path / "in" / "3.json").write_text('{"completed": false}')
    run()
    publish("4.json")  # the same marker under another name
    run()
    run("lost checkpoint")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    publish("5.json", wav="c" * 64)
    with pytest.raises(Exception, match="differ"):
        run()


def test_streamed_bouts(spark, tmp_path):
    from fieldlake.streaming.archive import bouts

    rows = [("a", 0, 1), ("a", 2, 3), ("a", 50, 51), ("b", 0, 5), ("a", 52, 53), ("a", 99, 100)]
    spark.createDataFrame(rows, "source string, onset long, offset long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, onset long, offset long").parquet(str(tmp_path / "in"))
    q = bouts(stream, 10).writeStream.format("memory").queryName("closed_bouts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("closed_bouts").collect()) == [("a", 1, 2, 3), ("a", 2, 2, 3)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_match_their_sql(spark):
    """Row counts of all queries against DuckDB; the driver compares values."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from fieldlake.plans import registry

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    sql = registry.oracle_sql()
    for name, f in registry.queries().items():
        if name in sql:
            got = f(spark, DATA)
            found = con.execute(sql[name])
            assert sorted(got.columns) == sorted(d[0] for d in found.description), name
            assert got.count() == len(found.fetchall()), name
    assert entry.entry(spark).count() > 0 and set(registry.queries()) <= set(entry.queries())
