"""Acoustic kernels against direct definitions, and folds with models over them."""

import collections

import numpy as np
import pytest


def test_band_pass_passes_its_band_without_delay():
    from fieldlake.functions.acoustics import _section, band_pass, butterworth

    rate, n = 48_000, 24_000
    t = np.arange(n) / rate
    inside, outside = np.sin(2 * np.pi * 5000 * t), np.sin(2 * np.pi * 100 * t)
    got = band_pass(inside + outside + 3, rate)
    assert np.abs(got - inside)[4000:-4000].max() < 1e-3
    sections = butterworth(5, 1500, 15000, rate)
    assert sections.shape == (5, 6) and all(np.abs(np.roots(s[3:])).max() < 1 for s in sections)
    gain = lambda f: np.abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for z in [np.exp(2j * np.pi * f / rate)] for s in sections]))
    assert abs(gain(1500) - 0.5**0.5) < 1e-9 and abs(gain(15000) - 0.5**0.5) < 1e-9
    x, s = np.random.default_rng(0).normal(size=700), sections[0]
    want, z1, z2 = [], 0.0, 0.0
    for v in np.concatenate([np.full(20_000, x[0]), x]):
        y = s[0] * v + z1
        z1, z2 = s[1] * v - s[4] * y + z2, s[2] * v - s[5] * y
        want.append(y)
    assert np.allclose(_section(x, s), want[20_000:], atol=1e-8)
    for bad in (x[:30], x[:0]):
        with pytest.raises(ValueError):
            band_pass(bad, rate)


def test_mel_and_cepstra():
    from fieldlake.functions import acoustics as A

    assert np.allclose(A.hz(A.mel([0, 400, 1000, 9000])), [0, 400, 1000, 9000])
    bank = A.mel_bank(48_000, 4096, 20)
    assert np.allclose(bank.sum(axis=1) * 48_000 / 4096, 1, atol=0.02)
    m = A.cosine_transform(20, 20)
    assert np.allclose(m @ m.T, np.eye(20))
    tone = np.sin(2 * np.pi * 4000 * np.arange(9600) / 48_000)
    patch = A.log_mel_patch(tone, 48_000)
    assert patch.shape == (64, 32) and abs(patch.mean()) < 1e-9 and abs(patch.std() - 1) < 1e-9
    assert not A.log_mel_patch(np.zeros(5000), 48_000).any()
    assert A.cepstral_vector(tone, 48_000).shape == (80,) and A.cepstral_vector(tone[:100], 48_000).shape == (80,)
    line = np.arange(12.0)[None, :] * 3
    assert np.allclose(A.slopes(line), 3) and not A.slopes(line[:, :2]).any()


def test_lag_and_measures():
    from fieldlake.functions import acoustics as A

    rng = np.random.default_rng(2)
    x = rng.normal(size=60_000)
    for by in (-700, 0, 1200):
        y = np.concatenate([np.zeros(max(0, by)), x[max(0, -by) :]])
        got = A.compared(x, y, 16_000)
        assert got["lag"] == by and got["correlation"] > 0.999 and abs(got["a_centroid"] - got["b_centroid"]) < 1
    m = A.spectral_measures(np.array([0, 1.0, 2, 1]), np.array([0, 10.0, 20, 30]))
    assert m["peak"] == 20 and m["centroid"] == 20 and A.spectral_measures(np.zeros(3), np.arange(3))["peak"] is None
    f, p = A.welch(np.sin(2 * np.pi * 1000 * np.arange(48_000) / 16_000), 16_000)
    assert abs(f[p.argmax()] - 1000) < 4 and abs(p.sum() * f[1] - 0.5) < 1e-2


def test_vectors_keep_bad_clips(spark):
    from fieldlake.functions.acoustics import vectors

    rows = spark.createDataFrame([("a", 48000, [0.1, -0.2] * 3000), ("b", 48000, None), ("c", 48000, [float("nan")] * 10), ("d", 48000, [])], "path string, rate int, samples array<double>")
    got = {r["path"]: r for r in rows.mapInPandas(lambda it: vectors(it, "log_mel"), "path string, vector array<float>, error string").collect()}
    assert len(got["a"]["vector"]) == 2048 and all(got[k]["error"] and got[k]["vector"] is None for k in "bcd")


def test_folds(spark):
    from fieldlake.operators import folds as O

    rows = [(i, "abc"[i % 3], f"g{i // 4}") for i in range(108)]
    df = spark.createDataFrame(rows, "id long, label string, unit string")
    got = O.feasible_folds(df, "unit", "label", 3)[0].collect()
    where = collections.defaultdict(set)
    for r in got:
        where[r["unit"]].add(r["fold"])
    assert len(got) == 108 and all(len(x) == 1 for x in where.values())
    assert max(collections.Counter(r["fold"] for r in got).values()) <= 40
    dealt = collections.Counter((r["label"], r["fold"]) for r in O.stratified_folds(df, "id", "label", 5).collect())
    assert all(n in (7, 8) for n in dealt.values()) and len(dealt) == 15
    lone = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "z")], "id long, label string, unit string")
    with pytest.raises(ValueError):
        O.feasible_folds(lone, "unit", "label", 2, tries=3)
    with pytest.raises(ValueError):
        O.group_folds(df, "unit", "label", 3, most_groups=5)


@pytest.mark.parametrize("model", ["logistic", "forest"])
def test_out_of_fold_scores(spark, model):
    from fieldlake.operators import folds as O

    rng = np.random.default_rng(0)
    rows = [(i, float(i % 4 == 0), float(i % 4 == 0) * 3 + float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(200)]
    df = O.stratified_folds(spark.createDataFrame(rows, "id long, y double, a double, b double"), "id", "y", 3)
    got = O.out_of_fold(df, "id", ["a", "b"], "y", 3, model, trees=20).collect()
    assert len(got) == 200 and np.mean([(r["score"] > 0.5) == r["y"] for r in got]) > 0.85
    assert abs(sum(r["importance"] for r in O.importances(df, ["a", "b"], "y", trees=10).collect()) - 1) < 1e-9


def test_registered_models_use_the_operators_settings(monkeypatch):
    from fieldlake.plans import models as M

    calls = []
    monkeypatch.setattr(M, "labelled", lambda t: type("Rows", (), {"select": lambda self, *c: self})())
    monkeypatch.setattr(M, "F", type("Any", (), {"col": staticmethod(lambda c: type("C", (), {"cast": lambda s, k: s, "alias": lambda s, k: s})()), "array": staticmethod(lambda *c: type("C", (), {"alias": lambda s, k: s})())}))
    monkeypatch.setattr(M.O, "importances", lambda *a, **k: calls.append(k))
    monkeypatch.setattr(M.E, "evidence", lambda *a, **k: (calls.append(k), None))
    monkeypatch.setattr(M.E, "summary", lambda runs: None)
    M.forest_importances(None)
    M.classification_evidence(None)
    assert calls == [{}, {}]
