"""Duplicate tiers: pairs, focus, bands, and no lost pair against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import dedup


def texts(spark, rows, focus=None):
    df = spark.createDataFrame(rows, "id string, text string")
    return df if focus is None else df.withColumn("focus", F.col("id").isin(focus))


def pairs(df):
    return {(r.left_id, r.right_id) for r in df.collect()}


def test_exact_and_focus(spark):
    rows = [("a", "Ein Text"), ("b", "ein  text"), ("c", "anders"), ("d", None)]
    assert pairs(dedup.exact_pairs(texts(spark, rows))) == {("a", "b")}
    assert pairs(dedup.exact_pairs(texts(spark, rows, ["c"]))) == set()


def grams(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else {t} if t else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_exact_loses_nothing(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        base = " ".join(rng.choice(["lo", "ret", "mi", "san", "du", "ka", "veri", "no"]) for _ in range(rng.choice([1, 3, 12, 60, 200])))
        rows.append((f"{k:03}a", base))
        for v in "bc":
            cut = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                cut[rng.randrange(len(cut))] = rng.choice("xyz")
            rows.append((f"{k:03}{v}", "".join(cut)))
    rows += [("e1", ""), ("e2", ""), ("n", None)]
    want = {}
    for (a, x), (b, y) in combinations([r for r in sorted(rows) if r[1]], 2):
        p, q = grams(x), grams(y)
        j = len(p & q) / len(p | q)
        if j >= 0.85 and " ".join(x.lower().split()) != " ".join(y.lower().split()):
            want[a, b] = j
    got = {(r.left_id, r.right_id): r.similarity for r in dedup.near_exact_pairs(texts(spark, rows)).collect()}
    assert want and got == pytest.approx(want)


def test_bands_and_corpus(spark):
    df = spark.createDataFrame([(0.99,), (0.95,), (0.9,)], "s double")
    assert [r[0] for r in df.select(dedup.band(F.col("s"))).collect()] == ["duplicate", "duplicate", "gray"]
    old, new = texts(spark, [("a", "x"), ("b", "y")]), texts(spark, [("a", "z")])
    got = {(r.id, r.text, r.focus) for r in dedup.corpus_of(new, old).collect()}
    assert got == {("a", "z", True), ("b", "y", False)}


def test_nearest_breaks_ties_by_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = [(r.other, r.rank) for r in dedup.nearest(df.where("id = 1"), df, k=2).orderBy("rank").collect()]
    assert got == [(2, 1), (4, 2)]
    assert dedup.nearest(df.limit(0), df, k=2).count() == 0


def test_unrelated_short_texts_meet_seldom(spark):
    rng = random.Random(6)
    for size in (6, 10, 20):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)) for _ in range(2000)]
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        sets = rows.select(F.col("id").alias("hash"), F.lit(True).alias("focus"), F.transform(T.shingles(F.col("text")), lambda g: F.xxhash64(g)).alias("grams")).withColumn("n", F.size("grams"))
        met = dedup.signatures(sets, 0.85).groupBy("sig").count().agg(F.max("count")).first()[0]
        assert met < 20


def test_similar_short_texts_are_found(spark):
    rows = [(k, t) for k, t in enumerate(["abcdef", "abcdeg", "abcde", "a", "ein kurzer satz ohne fehler darin steht", "ein kurzer satz ohne fehler darin stehe", "x" * 9, "x" * 30])]
    df = spark.createDataFrame(rows, "id long, text string")
    grams = {i: {t[k : k + 5] for k in range(len(t) - 4)} if len(t) > 5 else {t} for i, t in rows}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.85 * len(grams[a] | grams[b])}
    assert {(r.left_id, r.right_id) for r in dedup.near_exact_pairs(df).collect()} == want and want


def test_classes_of_many_copies_stay_linear(spark):
    from loomwright.operators import kept_index

    text = "Der Hund liest heute ein Buch im Garten und die Katze sieht ihm dabei zu."
    rows = [(k, text if k % 2 else text.upper() + "  ") for k in range(3000)] + [(5000 + k, text + " Ja.") for k in range(500)] + [(9000, None), (9001, ""), (None, text), (9002, "ganz anders")]
    got = kept_index.duplicate_classes(spark.createDataFrame(rows, "id long, text string"))
    found = [(r.kind, r.left_id, r.right_id) for r in got.collect()]
    assert len(found) == len(set(found)) == 2999 + 499 + 1 + 1
    assert {x for x in found if x[0] == "near-exact"} == {("near-exact", 0, 5000)} and ("copy", 9000, 9001) in found
    assert kept_index.duplicate_classes(spark.createDataFrame([], "id long, text string")).count() == 0


def _prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_near_exact_join_writes_less_than_twice_the_text(spark):
    """Long texts of one small vocabulary: neither their sets nor their signatures may outgrow them."""
    from pathlib import Path

    from loomwright.functions.folders import shared_dir

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(k, _prose(rng, words, 400)) for k in range(300)]
    rows += [(1000 + k, t + " noch ein satz") for k, t in rows[:20]]
    folder = Path(shared_dir(spark).removeprefix("file:"), "loomwright")
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    got = {(r.left_id, r.right_id) for r in dedup.near_exact_pairs(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {(k, 1000 + k) for k in range(20)}
    assert size() - before < 2 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_of_sketches_meet_all(spark, monkeypatch, block):
    from loomwright.operators import sketches

    monkeypatch.setattr(sketches, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = []
    for k in range(12):
        base = _prose(rng, ["lo", "ret", "mi", "säns", "du", "ka", "veri", "n\U0001f600o"], rng.choice([20, 60, 90]))
        rows.append((3 * k, base, k % 3 == 0))
        rows += [(3 * k + j, base[: len(base) * (20 - j) // 20] + "xyz" * j, k % 2 == 0) for j in (1, 2)]
    df = spark.createDataFrame(rows, "id long, text string, focus boolean")
    want = {}
    for (a, x, f), (b, y, g) in combinations(rows, 2):
        p, q = grams(x), grams(y)
        if (f or g) and len(p & q) / len(p | q) >= 0.85:
            want[a, b] = len(p & q) / len(p | q)
    got = {(r.left_id, r.right_id): r.similarity for r in dedup.near_exact_pairs(df).collect()}
    assert want and got == want


def test_texts_of_a_family_are_sent_once_not_with_each_pair(spark, monkeypatch):
    """300 near copies have 44,850 pairs; each text goes to the parts of its family alone."""
    from loomwright.functions.folders import written
    from loomwright.operators import sketches

    kept = {}
    monkeypatch.setattr(sketches, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(150)]
    rows = [(k, f"{' '.join(words)} {k:04}") for k in range(300)] + [(1000 + 2 * k + j, _prose(rng, words, 60) if not j else "") for k in range(5) for j in (0, 1)]
    got = dedup.near_exact_pairs(spark.createDataFrame(rows, "id long, text string"))
    assert {(r.left_id, r.right_id) for r in got.collect()} == set(combinations(range(300), 2))
    pairs = kept["pairs"].collect()
    assert len(pairs) == 44850
    assert len({(r.one, r.two, h) for r in pairs for h in (r.ha, r.hb)}) <= 300 * 3


@pytest.mark.parametrize("rows, top", [(1, 300), (90, 300), (700, 1270), (700, 9000)])
def test_tiles_of_sketches_lose_no_pair(rows, top):
    import numpy as np

    from loomwright.operators import sketches

    rng, words = np.random.default_rng(rows + top), max(4, -(-top // 128))
    first = sketches._telling(top, words, 0.85)
    assert first <= words and (top < 1000 or first < words)

    def side():
        bits = rng.integers(0, 1 << 63, (rows, words), np.uint64)
        half = rows // 2
        bits[1 : 2 * half : 2] = bits[: 2 * half : 2] ^ (rng.integers(0, 1 << 63, (half, words), np.uint64) * (rng.random((half, words)) < rng.random((half, 1))))
        return {"n": np.sort(rng.integers(int(0.8 * top), int(1.2 * top), rows)), "bits": bits}

    a, b = side(), side()
    b["bits"][: rows // 3] = a["bits"][: rows // 3]
    for x, y, same in ((a, a, True), (a, b, False)):
        differ = np.array([np.bitwise_count(y["bits"] ^ one).sum(axis=1) for one in x["bits"]])
        n, m = x["n"][:, None], y["n"][None]
        want = (differ <= 0.15 / 1.85 * (n + m)) & (np.minimum(n, m) >= 0.85 * np.maximum(n, m)) & (np.triu(np.ones_like(differ, bool), 1) if same else True)
        i, j = sketches._near(x, y, same, 0.85, first)
        assert len(i) == want.sum() and want[i, j].all() and (rows < 9 or want.any())
