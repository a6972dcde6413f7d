"""Clip vectors, frame peaks, and evidence over repeated folds."""

import numpy as np
import pytest


def test_clip_vector():
    from fieldlake.functions import acoustics as A

    rate, n = 48_000, 9600
    tone = np.sin(2 * np.pi * 3000 * np.arange(n) / rate)
    v = A.clip_vector(tone, rate)
    assert v.shape == (105,) and np.isfinite(v).all() and np.allclose(v[5:85], A.cepstral_vector(tone, rate))
    m, f = np.sqrt(A.power_frames(tone, 2048, 512)), np.fft.rfftfreq(2048, 1 / rate)
    shape = A.spectral_shape(m, f)
    for frame in (0, 9):
        c = sum(a * b for a, b in zip(f, m[:, frame])) / m[:, frame].sum()
        total, k = 0.0, 0
        while (total := total + m[k, frame]) < 0.85 * m[:, frame].sum():
            k += 1
        assert abs(shape[0, frame] - c) < 1e-6 and shape[2, frame] == f[k] and 0 < shape[3, frame] < 0.1
    assert abs(shape[0, 9] - 3000) < 30 and not v[93:100].any()
    assert v[100] == 0.2 and abs(v[101] - 2 * 3000 / rate) < 0.02 and abs(v[103] - 0.5**0.5) < 0.1
    assert A.clip_vector(tone[:100], rate)[100] == 2048 / rate
    silent = A.clip_vector(np.zeros(5000), rate)
    assert np.isfinite(silent).all() and silent[0] == 0 and np.allclose(A.spectral_shape(np.zeros((5, 2)), np.arange(5.0))[:, 0], [0, 0, 0, 1])


def test_contrast_and_onsets():
    from fieldlake.functions import acoustics as A

    f = np.arange(0, 101.0)
    m = np.ones((101, 2))
    m[30, 1] = 1000
    got = A.spectral_contrast(m, f, lowest=10, octaves=3)
    assert got.shape == (4, 2) and np.allclose(got[:, 0], 0) and got[2, 1] > 25 and np.allclose(got[[0, 1, 3], 1], 0)
    assert not A.spectral_contrast(m, f, lowest=30, octaves=3).any()
    x = np.zeros(48_000)
    x[24_000:24_200] = 1
    e = A.onset_envelope(x, 48_000)
    assert len(e) == 1 + 48_000 // 512 and abs(int(e.argmax()) - 24_000 // 512) <= 2 and not e[:3].any()


def test_frame_peaks():
    from fieldlake.functions import acoustics as A

    t = np.arange(9600) / 48_000
    a, b = np.sin(2 * np.pi * 3000 * t), np.sin(2 * np.pi * 4500 * t)
    same, other = A.frame_peaks(a, a, 48_000), A.frame_peaks(a, b, 48_000)
    assert same["max"] == 0 and same["frames"] == 1 + (9600 - 1024) // 256 and other["median"] == 1500 and other["over_100"] == 1
    assert A.frame_peaks(0 * a, b, 48_000)["median"] is None
    w = A.tukey(1024)
    assert w[0] == 0 and w[512] == 1 and np.allclose(w[1:], w[1:][::-1])
    with pytest.raises(ValueError):
        A.frame_peaks(a[:100], b, 48_000)


def test_multinomial_is_at_its_minimum():
    from fieldlake.operators.evidence import multinomial, scores

    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 150)
    y[:90] = 0
    x = rng.normal(size=(150, 4)) + 2 * np.eye(4)[y]
    w, b = multinomial(x, y, 4)
    count = np.bincount(y, minlength=4)
    weight = (150 / (3 * np.maximum(count, 1)))[y]
    z = x @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    away = weight[:, None] * (p / p.sum(axis=1, keepdims=True) - np.eye(4)[y])
    assert np.abs(x.T @ away + w).max() < 1e-4 and np.abs(away.sum(axis=0)).max() < 1e-4 and b[3] == -np.inf
    a, f, top, share = scores(np.array([0, 0, 1, 2]), np.eye(4)[[0, 1, 1, 0]])
    assert abs(a - 0.5) < 1e-12 and abs(f - (0.5 + 2 / 3 + 0) / 3) < 1e-12 and share[0, 1] == 0.5


def test_evidence(spark):
    from fieldlake.operators import evidence as E

    rng = np.random.default_rng(0)
    make = lambda gap: spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3) + gap * np.eye(3)[i % 3]], "abc"[i % 3], f"u{i // 6}") for i in range(180)] + [(999, None, "a", "u0")], "id long, v array<double>, l string, u string")
    runs, names = E.evidence(make(4.0), "id", "v", "l", "u", repeats=2, permutations=12)
    runs = spark.createDataFrame(runs.collect(), runs.schema)
    got = E.summary(runs).first()
    assert names == ["a", "b", "c"] and got["balanced_accuracy_mean"] > 0.9 and got["p"] == 1 / 13 and got["null_mean"] < 0.5 and got["top3_accuracy_mean"] == 1
    mine = [r for r in runs.collect() if r["kind"] == "repeat"]
    assert len({r["seed"] for r in mine}) == 2
    cells = E.recalls(runs, names).collect()
    assert len(cells) == 18 and abs(np.mean([c["share"] for c in cells if c["label"] == c["predicted"]]) - got["balanced_accuracy_mean"]) < 1e-9
    assert E.summary(E.evidence(make(0.0), "id", "v", "l", "u", repeats=1, permutations=12)[0]).first()["p"] > 1 / 13
    with pytest.raises(ValueError):
        E.evidence(make(0.0), "id", "v", "l", "u", most_rows=5)
    with pytest.raises(ValueError):
        E.evidence(make(0.0).where("false"), "id", "v", "l", "u")


def test_evidence_takes_any_number_of_rows_in_blocks(spark):
    import inspect

    from fieldlake.operators import evidence as E

    assert inspect.signature(E.evidence).parameters["most_rows"].default is None
    rng = np.random.default_rng(3)
    rows = [(i % 150, [float(v) for v in rng.normal(size=3) * [1, 100, 1] + 1.5 * np.eye(3)[i % 3]], "abc"[i % 3], f"u{i // 6}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, l string, u string")
    runs, names = E.evidence(df, "id", "v", "l", "u", repeats=2, permutations=20, block=40)
    got = runs.collect()
    x, y = np.array([r[1] for r in rows]), np.array(["abc".index(r[2]) for r in rows])
    for n, r in enumerate(got[:2]):
        folds = E.feasible_folds(df, "u", "l", 3, r["seed"])[0]
        where = {f["u"]: f["fold"] for f in folds.select("u", "fold").distinct().collect()}
        want = E.scores(y, E.out_of_fold_logits(x, y, np.array([where[q[3]] for q in rows]), 3))
        assert r["kind"] == "repeat" and r["iteration"] == n and np.allclose(r[3:6], want[:3], atol=1e-12) and np.allclose(r["confusion"], want[3].ravel())
    null = [r["balanced_accuracy"] for r in got[2:]]
    assert len(null) == 20 and 0.25 < np.mean(null) < 0.42 and len(set(null)) > 10
    assert got == E.evidence(df.repartition(3), "id", "v", "l", "u", repeats=2, permutations=20, block=40)[0].collect()
