"""Each corpus operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, gone string, parts int, n_lines int, n_words int"


def prose(rng, n, words="red green blue sun moon the of and a tree river stone bird song wind"):
    return " ".join(rng.choice(words.split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    passage = prose(rng, 90)
    out = [None, "", " \n\t ", "one", "one two three", "A b c d e f", "a B c d e f", "x" * 3000, "é" * 900, "ab " * 800, prose(rng, 6000)]
    out += base + [base[0], base[0], base[1]]
    for k in range(12):  # near copies of one text, which is the centre of a star
        w = base[2].split()
        w[rng.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    out += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(8)]
    sources = ["b", "a", None, "c", "é"]
    return [(k, x, rng.choice(["en", None]), sources[k % 5], len(x or ""), -1, "s", "g", 3, 4, 5) for k, x in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reach(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_minhash(docs, empty, rows):
    from fieldlake.llm.minhash_dedup import minhash_groups

    sets = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = reach(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_groups(docs).collect()}
    assert got == {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}
    assert minhash_groups(empty).count() == 0


def test_minhash_with_null_and_repeated_ids(spark):
    from fieldlake.llm.minhash_dedup import minhash_groups

    rng = random.Random(21)
    one, other = prose(rng, 60), prose(rng, 60)
    near = one.rsplit(" ", 1)[0] + " end"
    rows = [(None, one), (4, near), (4, other), (9, one), (None, other + " more"), (None, prose(rng, 40)), (None, None), (4, near)]
    got = collections.Counter(tuple(r) for r in minhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == {(None, 56, 4, False): 1, (4, 56, 4, True): 3, (9, 56, 4, False): 1, (None, 57, 4, False): 1, (None, 36, None, True): 1, (None, 0, None, True): 1}


def test_links_that_no_star_sees(spark):
    """Chains and rings of near copies: the middle of a bucket may be far from both ends."""
    from fieldlake.llm.minhash_dedup import minhash_groups

    rng, texts = random.Random(31), []
    for _ in range(12):
        w = prose(rng, 80).split()
        for k in range(12):
            texts.append(" ".join(w))
            w[rng.randrange(len(w))] = f"edit{k}"
    sets = [shingles(x) for x in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if a // 12 == b // 12 and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == reach(range(len(texts)), links)


@pytest.mark.parametrize("tile", [4, 1024])
def test_block_comparison_finds_what_stars_miss(tile):
    import pyarrow as pa

    from fieldlake.llm.minhash_dedup import _compare

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    block = [{"id": i, "comp": i % 4, "items": s.tolist()} for i, s in enumerate(sets)]  # links are between components
    kind = pa.list_(pa.struct([("id", pa.int64()), ("comp", pa.int64()), ("items", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([block[:11], block[11:]], type=kind), pa.array([block, block], type=kind)], names=["left", "right"])
    got = {(a, b) for x in _compare([batch], 50, columns=7, tile=tile) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    want = {(max(i % 4, j % 4), min(i % 4, j % 4)) for i in range(30) for j in range(i) if i % 4 != j % 4 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert got == want


def repeats(texts, length):
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = collections.Counter(d[k : k + length] for d in data.values() for k in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[i] = (len(d), kept, [m.span() for m in re.finditer("1+", "".join("1" if g else "0" for g in gone))])
    return out


@pytest.mark.parametrize("hot_bytes", [2 << 20, 0])
def test_suffix_array_dedup(docs, empty, rows, hot_bytes):
    from fieldlake.llm.suffix_dedup import Repeats, without_repeats

    p = Repeats(length=60, gram=8, shard_bytes=3000, hot_bytes=hot_bytes, range_strings=500)
    want = repeats({r[0]: r[1] for r in rows}, 60)
    got = {r["id"]: (r["n_bytes"], bytes(r["kept"]), [(s["start"], s["stop"]) for s in r["spans"]]) for r in without_repeats(docs, params=p).collect()}
    assert got == want
    assert without_repeats(empty).count() == 0


def test_repeats_with_null_and_repeated_ids(spark):
    from fieldlake.llm.suffix_dedup import Repeats, without_repeats

    rng = random.Random(19)
    passage, own = prose(rng, 40), [prose(rng, 20) for _ in range(5)]
    texts = [own[0] + passage, passage + own[1], own[2], own[3] + passage + own[4], "", own[2]]
    rows = list(zip([None, 3, 3, None, 3, 8], texts))
    want = repeats(dict(enumerate(texts)), 50)
    want = sorted((str(rows[k][0]), v[0], v[1], v[2]) for k, v in want.items())
    found = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), params=Repeats(length=50, gram=8)).collect()
    assert sorted((str(r["id"]), r["n_bytes"], bytes(r["kept"]), [(x["start"], x["stop"]) for x in r["spans"]]) for r in found) == want


def test_suffix_array_kernels():
    from fieldlake.llm.suffix_array import repeated, suffix_array

    rng = np.random.default_rng(0)
    for n, symbols in ((0, 2), (1, 2), (2, 2), (7, 2), (90, 2), (400, 3), (900, 200)):
        for _ in range(8):
            s = rng.integers(0, symbols, n).astype(np.int16)
            t = s.tolist()
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: t[i:])
            places = collections.defaultdict(list)
            for i in range(n - 2):
                if 0 not in t[i : i + 3]:
                    places[tuple(t[i : i + 3])].append(i)
            assert set(np.flatnonzero(repeated(s, 3))) == {i for v in places.values() if len(v) > 1 for i in v}


def test_mixture(docs, empty, rows):
    from fieldlake.llm.mixture import mixture, rendered, taken, targets

    got = {r["id"]: r for r in taken(*mixture(docs)).collect()}
    again = {r["id"]: r for r in taken(*mixture(docs.repartition(2))).collect()}
    assert got == again
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by_source = collections.Counter()
    for r in rows:
        by_source[r[3]] += size[r[0]]
    names = sorted(by_source, key=lambda x: (x is None, x))
    goal = dict(zip(names, targets([by_source[n] for n in names], [3, 1, 2, 3, 1], 1.5 * sum(size.values()))))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    for r in rows:
        g = got[r[0]]
        assert (g["size"], g["source_size"], g["source"]) == (size[r[0]], by_source[r[3]], r[3]) and g["target"] == pytest.approx(goal[r[3]]) and 0 <= g["taken"] <= 2 * g["size"]
    for n in names:
        mixed = sum(g["taken"] for g in got.values() if g["source"] == n)
        assert abs(mixed - goal[n]) <= max(64, 0.02 * goal[n])
    _, fragments = mixture(docs)
    texts = rendered(docs, fragments).collect()
    words = collections.Counter()
    for r in texts:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["gone"] == "g"
    assert words == {i: g["taken"] for i, g in got.items() if g["taken"]}
    whole = {r[0]: r[1] for r in rows}
    assert any(r["text"] == whole[r["doc_id"]] for r in texts)
    assert taken(*mixture(empty)).count() == 0


def test_mixture_of_null_and_repeated_ids(spark):
    from fieldlake.llm.mixture import mixture, rendered, taken

    rng = random.Random(17)
    rows = [(k, prose(rng, n), s) for k, n, s in ((1, 300, "a"), (1, 300, "a"), (1, 200, "b"), (None, 250, "a"), (None, 40, None), (2, 500, "c"))]
    rows[1] = rows[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    documents, fragments = mixture(docs)
    got = [(r["id"], r["source"], r["size"], r["taken"]) for r in taken(documents, fragments).collect()]
    assert sorted((str(i), str(s), n) for i, s, n, _ in got) == sorted((str(i), str(s), len(WORD.findall(t))) for i, t, s in rows)
    assert all(0 <= t <= 2 * n for _, _, n, t in got) and sum(t for *_, t in got) > 1500
    held = sum(len(WORD.findall(r["text"])) for r in rendered(docs, fragments).collect())
    assert held == sum(t for *_, t in got)


def test_shares_are_capped_and_passed_on():
    from fieldlake.llm.mixture import permuted, shard_counts, targets

    assert targets([10, 100, 100], [3, 1, 2], 315) == pytest.approx([20, 295 / 3, 590 / 3])
    assert targets([0, 0], [3, 1], 0) == [0, 0]
    quota = np.array([1000, 30, 0, 470])
    counts = shard_counts(quota, 64, 1)
    assert (counts.sum(axis=0) == quota).all() and (counts.sum(axis=1)[:-1] == 64).all()
    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, 9, dtype=np.uint64)).tolist()) == list(range(n))


def line_form(line):
    line = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", line).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def similar_lines(a, b):
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) * 5 <= longer and 5 * distance(a, b) <= longer


def test_line_dedup(spark, empty):
    from fieldlake.llm import line_dedup as L

    rng = random.Random(3)
    long = prose(rng, 400)
    lines = [prose(rng, 12) for _ in range(12)] + ["", "short", "   ", long, long.replace("sun", "son", 1), long + " x", "A-B c 123 common line of all", "a b C 987 common, line of all"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))), None, None, 0, 1, "s", "g", 2, 3, 4) for k in range(60)] + [(60, None, None, None, 0, 1, "s", "g", 2, 3, 4), (61, "", None, None, 0, 1, "s", "g", 2, 3, 4)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    form = {(r[0], n): line_form(x) for r in rows if r[1] is not None for n, x in enumerate(r[1].split("\n"))}
    distinct = sorted({f for f in form.values() if len(f) >= L.LEAST_CHARS})
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if similar_lines(distinct[i], distinct[j])]
    assert links  # the long lines differ by a word
    group = reach(range(len(distinct)), links)
    first, want = {}, collections.defaultdict(list)
    for key in sorted(form):
        f = form[key]
        if len(f) < L.LEAST_CHARS or first.setdefault(group[distinct.index(f)], key) == key:
            want[key[0]].append(key[1])
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["gone"]) for r in L.dedup_lines(docs).collect()}
    for r in rows:
        split = r[1].split("\n") if r[1] is not None else []
        assert got[r[0]] == ("\n".join(split[n] for n in want[r[0]]) if r[1] is not None else None, len(split), "g")
    assert L.dedup_lines(empty).count() == 0


def test_near_copy_lines_beyond_the_simhash_blocks(spark):
    """Against all pairs by edit similarity alone: lines of many lengths with a word replaced or letters mistyped."""
    from fieldlake.llm import line_dedup as L

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyé") for _ in range(rng.randint(3, 8)))
    lines = []
    for n in (8, 12, 20, 40, 80, 150) * 10:
        w = [word() for _ in range(n)]
        near, typo = list(w), list(w)
        near[rng.randrange(n)] = word()
        typo[rng.randrange(n)] += "x"
        lines += [" ".join(x) for x in (w, near, typo)]
    # Lines of other base lines have nothing in common.
    links = [(i, j) for i in range(len(lines)) for j in range(i - i % 3, i) if similar_lines(lines[i], lines[j])]
    group = reach(range(len(lines)), links)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(docs).collect()}
    want = {i: int(group[i] != i) for i in group}
    assert all(got[i] <= want[i] for i in want) and sum(want.values()) > 100
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_line_dedup_with_null_and_repeated_ids(spark):
    from fieldlake.llm import line_dedup as L

    one, other = "the one line that is here more than once", "a line of its own that nothing else is like"
    rows = [(None, one), (7, one + "\n" + other), (7, one), (7, one), (3, "short\n" + one), (None, one)]
    got = collections.Counter((r["doc_id"], r["text"], r["n_removed"]) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == {(3, "short\n" + one, 0): 1, (7, other, 1): 1, (7, "", 1): 2, (None, "", 1): 2}
    rows = [(None, one), (None, one)]
    got = sorted(r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["", one]


def test_remembered_pieces_grow_and_start_afresh(monkeypatch):
    from fieldlake.llm import tokens

    monkeypatch.setattr(tokens, "merger", lambda path: lambda pieces: [[len(x), ord(x[-1])] for x in pieces])
    monkeypatch.setattr(tokens, "MOST_PIECES", 300)
    monkeypatch.setattr(tokens.Encoder, "SLOTS", 16)
    rng, one = random.Random(4), tokens.Encoder("none")
    for words in (3, 40, 200, 250, 900, 5):
        texts = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(words)) for _ in range(2)]
        data = [x.encode() for x in texts]
        ids, at = one.encode(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))
        want = [[i for x in re.findall(" ?[a-z]+", text) for i in (len(x), ord(x[-1]))] for text in texts]
        assert [ids[at[k] : at[k + 1]].tolist() for k in (0, 1)] == want


@pytest.mark.parametrize("tile", [3, 64])
def test_linked_classes_form_a_forest_of_all_links(tile):
    import pyarrow as pa

    from fieldlake.llm import line_dedup as L

    rng = random.Random(8)
    forms = ["red green blue sun", "red green blue son", "red green blues son", "moon", "a moon"]
    side = [{"v": v, "comp": rng.choice([v, v - v % 50]), "form": rng.choice(forms)} for v in rng.sample(range(1000), 60)]
    main = collections.Counter(x["comp"] for x in side).most_common(1)[0][0]
    for x in side:
        x |= {"main": x["comp"] == main, "centre": False, "chars": len(x["form"]), "s0": 0, "s1": 0, "q0": 0, "q1": 0}
    kind = pa.list_(pa.struct([(c, pa.string() if c == "form" else pa.bool_() if c in ("main", "centre") else pa.int64()) for c in ("v", "comp", "main", "centre", "chars", "s0", "s1", "q0", "q1", "form")]))
    links = [(x["comp"], y["comp"]) for x in side for y in side if similar_lines(x["form"], y["form"])]
    comps = {x["comp"] for x in side}
    outside = [x for x in side if not x["main"]]
    rows = [(a, b) for a in (outside[:20], outside[20:]) for b in (side[:30], side[30:])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k in (0, 1)], names=["left", "right"])
    got = [(a, b) for x in L._linked([batch], 80, tile, 5) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert set(got) <= set(links) and len(got) < len(comps) and reach(comps, got) == reach(comps, links)


def test_edit_distance(monkeypatch):
    from fieldlake.llm import line_dedup as L

    rng = random.Random(2)
    for _ in range(800):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most = rng.randint(0, 12)
        assert L.edit_distance(a, b, most) == min(distance(a, b), most + 1)
    pairs = []
    for n in (0, 1, 5, 30, 70, 150) * 25:
        a = [rng.choice("abcdefé 𝒳") for _ in range(n)]
        b = list(a)
        for _ in range(rng.choice([0, n // 20, n // 6, n // 4, n // 2])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        pairs.append(("".join(a), "".join(b)))
    want = [similar_lines(a, b) for a, b in pairs]
    assert 20 < sum(want) < len(want) - 20
    assert L.similar(*zip(*pairs), 80).tolist() == want
    assert not any(L.near(a, b, max(len(a), len(b)) // 5) and not w for (a, b), w in zip(pairs, want))
    assert L.similar(*zip(*pairs), 80, often=False).tolist() == want
    for name, small in (("MASK_BYTES", 1), ("MOST_PAIRS", 3), ("FEW", 0), ("FEW", 1000)):
        with monkeypatch.context() as patch:
            patch.setattr(L, name, small)
            assert L.similar(*zip(*pairs), 80, often=False).tolist() == want
    for most in (0, 1, 62, 63, 64, 65, 127, 128, 200):  # as many diagonals as words hold, one less and one more
        a, b = (["".join(rng.choice("ab") for _ in range(rng.randint(150, 200))) for _ in range(12)] for _ in range(2))
        a, b = zip(*(sorted(x, key=len) for x in zip(a, b)))
        limits = np.array([max(most, len(y) - len(x)) for x, y in zip(a, b)])
        assert L._within(a, b, limits).tolist() == [distance(x, y) <= k for x, y, k in zip(a, b, limits)]
    monkeypatch.setattr(L, "LONG", 10)
    assert L.similar(*zip(*pairs), 80).tolist() == want


def test_saved_tables_leave_no_shuffles(spark):
    from fieldlake.llm.store import CLEAN, Scratch

    before = spark.conf.get(CLEAN)
    counted = spark.range(1000).selectExpr("id % 10 as k").groupBy("k").count()
    table = Scratch(spark, "shuffles").save(counted)
    assert sorted(table.collect()) == sorted(counted.collect()) and spark.conf.get(CLEAN) == before
    with pytest.raises(Exception):
        Scratch(spark, "shuffles").save(spark.range(3).selectExpr("raise_error('no') as x"))
    assert spark.conf.get(CLEAN) == before


def test_embeddings(spark):
    from fieldlake.llm.embedding_dedup import embedding_groups

    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.4])).tolist() for _ in range(10)]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [1.0, 2.0], [float("inf")] * 16, [1e300] * 16]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, id string").repartition(4)
    unit = {}
    for i, v in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0:
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    n, group = collections.Counter(x for p in links for x in p), reach(range(len(rows)), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(df).collect()}
    assert got.keys() == set(range(len(rows)))
    found = sum(g[0] for g in got.values())
    assert 0.97 * 2 * len(links) <= found <= 2 * len(links) and all(got[i][0] <= n[i] for i in got)
    assert sum(got[i][1] == group[i] for i in got) >= 0.97 * len(rows)
    ids = [(None, rows[0]), (5, rows[0]), (5, rows[20]), (7, [2 * x for x in rows[20]]), (None, rows[60]), (None, None)]
    twice = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(spark.createDataFrame(ids, "vec_id long, embedding array<double>")).collect())
    assert twice == [("5", 1, 5, True), ("5", 1, 5, True), ("7", 1, 5, False), ("None", 0, None, True), ("None", 0, None, True), ("None", 1, 5, False)]
    assert embedding_groups(df.where("false")).count() == 0


def test_visited_cells_reach_neighbours_that_the_sample_lacks():
    from fieldlake.llm import embedding_dedup as E

    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(3000, 64)))  # no two are linked
    books = E.codebook(x[:, :32], 40, 1), E.codebook(x[:, 32:], 40, 2)
    cells = E.cells_for(x, books, 0.9)
    aside = rng.normal(size=x.shape)
    near = 0.9 * x + np.sqrt(1 - 0.81) * unit(aside - (aside * x).sum(axis=1)[:, None] * x)
    d = [E.distances(y[:, a:b], book) for y in (x, near) for a, b, book in ((0, 32, books[0]), (32, 64, books[1]))]
    seen = E.visited(d[0], d[1], cells)
    found = (seen == (d[2].argmin(axis=1) * 40 + d[3].argmin(axis=1))[:, None]).any(axis=1)
    assert found.mean() >= 0.99 and cells < 1600


def test_groups_lose_no_link(spark, monkeypatch):
    from fieldlake.llm import embedding_dedup as E

    monkeypatch.setattr(E, "GROUP", 50)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 32))
    x = np.concatenate([x, x[:60] + 0.3 * rng.normal(size=(60, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)).sum(axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in E.embedding_groups(df).collect()}
    assert want.sum() > 60 and all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum()


def test_multi_sequence_order():
    from fieldlake.llm.embedding_dedup import visited

    rng = np.random.default_rng(0)
    d1, d2 = rng.random((20, 9)), rng.random((20, 9))
    for cells in (1, 5, 30, 81, 200):
        got = visited(d1, d2, cells)
        total = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
        want = np.sort(total, axis=1)[:, : min(cells, 81)]
        assert np.allclose(np.sort(np.take_along_axis(total, got, 1), axis=1), want)


def test_licenses(spark, empty):
    from fieldlake.llm.license_scan import KNOWN, known_digests, scanned

    mit = KNOWN[0][1]
    texts = [mit, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(" ", "\n  "), mit.replace("sublicense", "sub-license").replace('"', "'"), mit + " and more", None, "", "some text\n  licenced under the APACHE licence, v2.0!\nmore", "Licensed under CC BY-NC 4.0.\nLicensed under the MIT License."]
    df = spark.createDataFrame([(k, x, "z") for k, x in enumerate(texts)], "doc_id long, text string, license string")
    got = {r["id"]: (r["license"], r["notices"]) for r in scanned(df, known_digests(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert got[6][1] == "Apache-2.0" and got[7][1] == "CC-BY-NC-4.0,MIT" and got[4][1] is None and got[3][1] is None
    assert scanned(empty, known_digests(spark)).count() == 0
    plan = scanned(df, known_digests(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_license_files(spark):
    from pathlib import Path

    from fieldlake.llm.license_scan import FULL, KNOWN, known_digests, scanned

    bsd = """BSD 3-Clause License

Copyright (c) 2021, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

""" + next(x for n, x in FULL if n == "BSD-3-Clause").rsplit("\n", 1)[1]
    texts = [("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + KNOWN[0][1]), ("ISC", "ISC License\n\nCopyright (c) 2020 A. Person\n" + KNOWN[1][1]), ("BSD-3-Clause", bsd), (None, bsd + " and more")]
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3"), ("LGPL-2.1-only", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        path = Path("/usr/share/common-licenses", file)
        if path.exists():
            texts += [(name, path.read_text()), (None, path.read_text()[:-200])]
            if name == "Apache-2.0":
                texts.append((name, path.read_text().replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2019 A. Person")))
    df = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: r["license"] for r in scanned(df, known_digests(spark)).collect()}
    assert [got[k] for k in range(len(texts))] == [n for n, _ in texts]


def test_packing(docs, empty, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from fieldlake.llm import packing
    from fieldlake.llm.store import Scratch

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    scratch = Scratch(docs.sparkSession, "test")
    pieces = packing.token_pieces(docs, scratch, path, 256)
    assigned = packing.assign(pieces, scratch, 256, most_open=5, task_pieces=20)
    got = collections.defaultdict(dict)
    spaces = collections.defaultdict(list)
    for r in pieces.join(assigned, ["row", "piece"]).collect():
        got[r["id"]][r["piece"]] = (r["start"], r["length"], bytes(r["ids"]))
        spaces[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"]), r["id"]))
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        parts = [got[r[0]][k] for k in range(len(got[r[0]]))]
        assert b"".join(p[2] for p in parts) == np.array(ids, dtype="<u4").tobytes()
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts])[:-1].tolist()
        assert all(p[1] == 256 for p in parts[1:]) and 1 <= parts[0][1] <= 256
    left = collections.Counter((r["id"], bytes(r["ids"])) for r in pieces.collect())
    for r in packing.sequences(pieces, 256, most_open=5, task_pieces=20).collect():
        ids, at = bytes(r["ids"]), 0
        assert r["length"] == len(ids) // 4 <= 256
        for doc in r["doc_ids"]:
            piece = next(p for (i, p), n in left.items() if i == doc and n and ids.startswith(p, at))
            left[doc, piece] -= 1
            at += len(piece)
        assert at == len(ids)
    assert not +left
    for k, held in spaces.items():
        held.sort()
        assert [h[0] for h in held] == np.cumsum([0] + [h[1] for h in held])[:-1].tolist() and sum(h[1] for h in held) <= 256
    assert packing.token_pieces(empty, scratch, path).count() == 0


def test_bins_are_best_fit_and_bounded():
    from fieldlake.llm.packing import Bins

    bins = Bins(10, 2)
    assert [bins.place(x) for x in (6, 7, 3, 4, 10, 9, 9, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0), (5, 0), (4, 9)] or bins.open <= 2


def test_tokens_equal_the_tokenizers_library():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    from fieldlake.llm.tokens import token_arrays

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = ["a", "b", "s", "t", "re", "ve", "ll", "d", "'", "'", " ", " ", "\n", "\t", "1", "½", "é", "中", ".", "_", "　", "😀", "<|endoftext|>", "\x85", "​", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["don't", "x's y", "'s", " 's", "''s", "  ", ""]
    got = [ids[offsets[k] : offsets[k + 1]].tolist() for at, to, ids, offsets in token_arrays(pa.array(texts), path) for k in range(to - at)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_quality_rules(docs, empty, rows):
    from fieldlake.llm.quality_rules import SYMBOLS, judged

    got = {r["doc_id"]: r for r in judged(docs).collect()}
    for r in rows:
        text, w = r[1] or "", WORD.findall(r[1] or "")
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        g = got[r[0]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (g["kept"] and g["base_failed"])
    assert judged(empty).count() == 0


def test_chat_format(spark):
    from fieldlake.llm import chat_format as C
    from fieldlake.llm.store import Scratch

    scratch = Scratch(spark, "test")
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "sys\ntem", "a\\b</s>[INST"), (2, 1, "assistant", "<s>[/INST] ok\n"), (2, 1, "assistant", "<s>[/INST] ok\n"), (None, None, None, ""), (3, 5, "assistant", "only" * 5000)] + [(4, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(37)]
    df = spark.createDataFrame([(*r, 7) for r in said], "conv_id long, turn long, role string, text string, tree int")
    got = {r["conv_id"]: r for r in C.digests(C.formatted(scratch.save(C.linear_messages(df)), scratch)).collect()}
    own = collections.defaultdict(list)
    for c, k, role, text in said:
        own[c].append((-1 if k is None else k, role or "", text or ""))
    assert got.keys() == own.keys()
    for c, turns in own.items():
        turns.sort()
        learnt = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert C.digests(C.formatted(C.linear_messages(df.where("false")), scratch)).count() == 0


def test_reply_trees(spark):
    from fieldlake.llm import chat_format as C
    from fieldlake.llm.store import Scratch

    scratch = Scratch(spark, "test")
    #  1 - 2 - 3 (score 1), 2 - 4 (score 5), 9 hangs on a missing parent, 20 <-> 21 is a cycle with leaf 22.
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 1.0), (1, 4, 2, 5.0), (2, 9, 8, 1.0), (3, 20, 21, 1.0), (3, 21, 20, 1.0), (3, 22, 21, 1.0), (4, 1, None, 1.0), (4, 5, 1, 2.0), (4, 6, 1, 2.0)]
    m = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in nodes], "tree long, node long, parent long, role string, text string, score double")
    best = {r["tree"]: [x for _, x in C.read_turns(r["formatted"])] for r in C.formatted(m, scratch).collect()}
    assert best == {1: ["m1", "m2", "m4"], 2: ["m9"], 4: ["m1", "m5"]}
    every = sorted((r["tree"], [x for _, x in C.read_turns(r["formatted"])]) for r in C.formatted(m, scratch, best_only=False).collect())
    assert every == [(1, ["m1", "m2", "m3"]), (1, ["m1", "m2", "m4"]), (2, ["m9"]), (4, ["m1", "m5"]), (4, ["m1", "m6"])]


def test_messages_below_cycles_cost_a_row_each_round(spark, monkeypatch):
    from fieldlake.llm import chat_format as C
    from fieldlake.llm.store import Scratch

    sizes, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: sizes.append((out := save(self, df)).count()) or out)
    nodes = [(1, k, k - 1 if k else None, 1.0) for k in range(300)] + [(2, 0, 1, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0)] + [(3, k, (k + 1) % 5, 1.0) for k in range(5)]
    m = spark.createDataFrame([(t, n, p, "user", "x", s) for t, n, p, s in nodes], "tree long, node long, parent long, role string, text string, score double")
    got = {r["tree"]: len(C.read_turns(r["formatted"])) for r in C.formatted(m, Scratch(spark, "cycles")).collect()}
    assert got == {1: 300} and max(sizes) <= len(nodes) and len(sizes) <= 24


def test_language_id(spark):
    from fieldlake.llm import language_id as I

    rng = random.Random(8)
    syllables = {"xx": "ka lo mi ru ta ne so".split(), "yy": "sch ung ber ein ach ver".split(), "zz": "ción que los por ñar ez".split()}
    text = lambda k: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60)))
    rows = [(i, text(k), k, "s") for i, k in enumerate(rng.choice(sorted(syllables)) for _ in range(600))] + [(900, None, "xx", "s"), (901, "", "yy", "s"), (902, "123 !!", "zz", "s"), (903, "a", None, "s"), (904, "ka", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    model = I.fit(df.where(~I.held_out()), sample_docs=100)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in I.predicted(df, model).collect()}
    out = [(r[2], got[r[0]][0]) for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] in syllables and all(0 <= s <= 1 for _, s in got.values())
    assert I.predicted(df.where("false"), model).count() == 0
    assert {r["lang_pred"] for r in I.predicted(df, I.fit(df.where("false"))).collect()} == {"und"}


def test_more_than_64_languages(spark):
    from fieldlake.llm import language_id as I

    word = lambda k: "".join(random.Random(k).sample("abcdefghijklmnopqrstuvwxyz", 8))
    rows = [(k, f"{word(k)} {word(1000 + k)}", f"l{k:03}") for k in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r["id"]: r["lang_pred"] for r in I.predicted(df, I.fit(df)).collect()}
    assert got == {k: lang for k, _, lang in rows}


def test_components(spark):
    from fieldlake.llm.graph import components
    from fieldlake.llm.store import Scratch

    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2050)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "test")).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in reach(ids, [x for x in links if x[0] != x[1]]).items()}
    assert components(df.where("false"), Scratch(spark, "test")).count() == 0


def test_line_dedup_leaves_no_table_of_lines_beside_the_last_join(spark):
    from pathlib import Path

    from fieldlake.llm import line_dedup as L
    from fieldlake.llm import store

    top = Path(store.shared_folder(spark).removeprefix("file://"))
    before = set(top.glob("lines-*"))
    rows = [(k, f"this line says number {k % 7} of the very same words\nand {k} is a line on its own, by {'abcdefg'[k % 7] * 9}") for k in range(40)]
    found = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    (folder,) = set(top.glob("lines-*")) - before
    left = [spark.read.parquet(str(p)).columns for p in folder.iterdir()]
    assert ["row", "gone"] in left and not any("h" in columns for columns in left)
    assert sum(r["n_removed"] for r in found.collect()) >= 39


def test_pairs_are_compared_in_their_first_key_only(monkeypatch):
    import pyarrow as pa

    from fieldlake.llm import line_dedup as L

    rng = random.Random(5)
    words, kinds = ["s0", "s1", *(f"n{k}" for k in range(6))], 16
    halves = [[rng.choice([1, 2, 3]) for _ in range(kinds)] for _ in range(24)]
    side = [{"v": v, "comp": v, "main": False, "centre": False, "chars": 30, "q0": 0, "q1": 0, "form": f"form {v}"} | {w: h[2 * k] | h[2 * k + 1] << 32 for k, w in enumerate(words)} for v, h in enumerate(halves)]
    monkeypatch.setattr(L, "alike", lambda left, right: np.ones(len(left[0]), dtype=bool))
    seen = collections.Counter()
    monkeypatch.setattr(L, "similar", lambda a, b, percent, often=True: (seen.update(tuple(sorted(p)) for p in zip(a, b)), np.zeros(len(a), dtype=bool))[1])
    kind = pa.list_(pa.struct([(c, pa.string() if c == "form" else pa.bool_() if c in ("main", "centre") else pa.int64()) for c in ("v", "comp", "main", "centre", "chars", *words, "q0", "q1", "form")]))
    for turn in range(kinds):
        for block in (1, 2, 3):
            part = [x for x, h in zip(side, halves) if h[turn] == block]
            batch = pa.RecordBatch.from_arrays([pa.array([part], type=kind), pa.array([part], type=kind), pa.array([turn << 32 | block])], names=["left", "right", "key"])
            list(L._linked([batch], 80))
    want = {tuple(sorted((f"form {v}", f"form {w}"))) for v in range(24) for w in range(v) if any(x == y for x, y in zip(halves[v], halves[w]))}
    assert set(seen) == want and set(seen.values()) == {1}


def test_pairs_too_different_in_their_symbols_are_not_aligned(monkeypatch):
    from fieldlake.llm import line_dedup as L

    rng = random.Random(21)
    a = ["".join(rng.choices("abcdefgh é≥", k=rng.randint(0, 90))) for _ in range(150)]
    b = ["".join(rng.choice("aé") if rng.random() < 0.15 else c for c in x) if rng.random() < 0.6 else "".join(rng.choices("abij", k=rng.randint(0, 90))) for x in a]
    least, want = L.least_distance(a, b).tolist(), [distance(x, y) for x, y in zip(a, b)]
    assert all(x <= y for x, y in zip(least, want)) and sum(least) * 2 > sum(want)
    aligned = []
    monkeypatch.setattr(L, "FEW", 1 << 30)
    monkeypatch.setattr(L, "edit_distance", lambda x, y, most, f=L.edit_distance: (aligned.append((x, y)), f(x, y, most))[1])
    assert L.similar(a, b, 80, often=False).tolist() == [similar_lines(x, y) for x, y in zip(a, b)]
    far = sum(x * 5 > max(len(p), len(q)) for x, p, q in zip(least, a, b))
    assert far > 20 and len(aligned) == len(a) - far


def test_classes_and_partners_in_records(monkeypatch):
    """What goes from task to task as bytes, against the same by dictionaries; parts are held one at a time."""
    import pyarrow as pa

    from fieldlake.llm import line_dedup as L

    monkeypatch.setattr(L, "RECORDS_BYTES", 4096)
    rng = random.Random(22)
    lines = [prose(rng, n) for n in (5, 6, 9, 30) * 12] + ["été à la mer, où tout est calme et où rien ne bouge"]
    rows = [(k % 2, k, rng.choice([None, 3, -1, k]), "\n".join(rng.choice([*lines, "", "x"]) + rng.choice(["", "", " one more word"]) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    kind = pa.struct([("file", pa.int64()), ("place", pa.int64())])
    batches = [pa.RecordBatch.from_arrays([pa.array([{"file": r[0], "place": r[1]} for r in part], type=kind), pa.array([r[2] for r in part], type=pa.int64()), pa.array([r[3] for r in part])], names=["row", "id", "text"]) for part in (rows[:25], rows[25:])]
    out = [x for b in L._lines(iter(batches), 20) for x in b.to_pylist()]
    said = [((r[0], r[1]), r[2], n, line_form(x)) for r in rows for n, x in enumerate(r[3].split("\n")) if len(line_form(x)) >= 20]
    found = {(x["row"]["file"], x["row"]["place"], x["line"]): (x["h"], x["g"]) for x in out if x["blob"] is None}
    assert set(found) == {(*row, n) for row, _, n, _ in said}
    hashes = {form: found[*row, n] for row, _, n, form in said}
    assert len(set(hashes.values())) == len(hashes) and all(found[*row, n] == hashes[form] for row, _, n, form in said)

    def dealt(records):
        records = sorted(records, key=lambda x: x[0])
        return iter([pa.RecordBatch.from_arrays([pa.array([x[0] for x in records], type=pa.int32()), pa.array([x[1] for x in records], type=pa.binary())], names=["part", "blob"])])

    classes = [x for b in L._classes(dealt([(x["part"], x["blob"]) for x in out if x["blob"] is not None])) for x in b.to_pylist()]
    first = {}
    for row, id_, n, form in sorted(said, key=lambda x: (x[1] is None, x[1] or 0, x[0], x[2])):
        first.setdefault(hashes[form], {"last": id_ is None, "id": id_, "row": {"file": row[0], "place": row[1]}, "line": n})
    assert {(x["h"], x["g"]): x["first"] for x in classes} == first and len(classes) == len(first)
    assert {(x["h"], x["g"]): x["chars"] for x in classes} == {h: len(form) for form, h in hashes.items()}

    columns = [pa.array(range(len(classes))), *(pa.array([x[c] for x in classes]) for c in ("chars", *L._words))]
    keyed = list(L._keys(iter([pa.RecordBatch.from_arrays(columns, names=["v", "chars", *L._words])])))
    got = [(x["key"], x["v"]) for b in L._partners(dealt([(x["part"], x["blob"]) for b in keyed for x in b.to_pylist()]), 80) for x in b.to_pylist()]
    sharing = collections.defaultdict(list)
    for v, x in enumerate(classes):
        for k in range(2 * len(L._words)):
            sharing[(x[L._words[k // 2]] >> 32 * (k % 2)) & 0xFFFFFFFF | k << 32].append(v)
    chars = [x["chars"] for x in classes]
    want = {(key, v) for key, of in sharing.items() for v in of for w in of if v != w and 100 * min(chars[v], chars[w]) >= 80 * max(chars[v], chars[w])}
    assert set(got) == want and len(got) == len(want) > 100
    assert not list(L._lines(iter([]), 20)) and not list(L._partners(iter([]), 80))
