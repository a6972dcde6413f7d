"""Scaling, comparison and review operators."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from fieldlake.operators import records as C


def test_scaling_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=41), "b": np.full(5, 2.0), "c": rng.normal(size=8) * 9}
    df = spark.createDataFrame([(k, i, float(v)) for k, own in x.items() for i, v in enumerate(own)], "k string, i int, v double").repartition(3)
    for robust in (False, True):
        got = {(r["k"], r["i"]): r["scaled"] for r in C.scaled(df, "v", ["k"], robust).collect()}
        for k, own in x.items():
            q1, m, q3 = np.percentile(own, [25, 50, 75])
            centre, spread = (m, q3 - q1) if robust else (own.mean(), own.std())
            assert np.allclose([got[k, i] for i in range(len(own))], (own - centre) / (spread or 1))


def test_principal_components_match_an_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 0.1]
    scores, shares = C.principal(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>"), "i", "v", 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(shares, values[:3] / values.sum())
    s = np.array([r["scores"] for r in scores.orderBy("i").collect()])
    assert np.allclose(np.cov(s.T), np.diag(values[:3]), atol=1e-8)


def test_tolerances_nulls_and_missing_paths(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.0), ("n", None), ("m", None), ("one", 1.0), ("z", 1e9)], "p string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", 1e-6), ("n", None), ("m", 1.0), ("two", 1.0), ("z", 1e9 + 0.05)], "p string, v double")
    got = {r["p"]: r["agrees"] for r in C.compared(a, b, "p", "v").collect()}
    assert got == {"x": True, "y": False, "n": True, "m": False, "one": False, "two": False, "z": True}


def test_payload_kinds_and_truth(spark):
    df = spark.createDataFrame([("e", 0), ("e", 0), ("n", 5), ("m", 0), ("m", 4), ("u", None), ("u", 3)], "k string, s int")
    got = {r["k"]: r["kind"] for r in df.groupBy("k").agg(C.payload_kind("s").alias("kind")).collect()}
    assert got == {"e": "empty", "n": "nonempty", "m": "unverified", "u": "unverified"}
    df = spark.createDataFrame([(" True",), ("1",), ("YES ",), ("no",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(C.truth("v")).collect()] == [True, True, True, False, False, None]


def test_offsets_are_required(spark):
    df = spark.createDataFrame([("2024-05-01T00:00:00+02:00",), ("2024-05-01T00:00:00Z",), ("2024-05-01T00:00:00",), ("nothing Z",)], "s string")
    assert [r[0] for r in df.select(C.utc_seconds(F.col("s"))).collect()] == [1714514400, 1714521600, None, None]


def test_canonical_hash_equals_sorted_json(spark):
    rows = [(1, 'a "quoted"\nline', None), (2, "é", 2.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "z long, b string, a double").select(F.sha2(C.canonical_json({"z": "z", "b": "b", "a": "a"}), 256)).collect()]
    want = [hashlib.sha256(json.dumps({"z": z, "b": b, "a": a}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for z, b, a in rows]
    assert got == want


def test_each_review_sees_what_the_ones_before_it_left(spark):
    steps = ["add", "add", "remove", "remove", "defer", "add", "defer", None, "other"]
    rows = [(1, k, d, False, True) for k, d in enumerate(steps)] + [(2, 0, "add", True, False), (3, 0, "remove", True, True)]
    out = C.reviewed(spark.createDataFrame(rows, "k int, n int, d string, base boolean, known boolean"), "k", ["n"], "d", "base", "known")
    got = [r["outcome"] for r in out.orderBy("k", "n").collect()]
    assert got == ["added", "already_member", "removed", "already_absent", "deferred_candidate", "added", "deferred_member", "missing_decision", "invalid_decision", "unmatched", "removed"]
