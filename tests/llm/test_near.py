"""Near-duplicates, components and Hamming search against brute force, with odd inputs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import hamming, neardup, queries
from loomwright.llm import neardup_kernel as kernel
from loomwright.llm.components import connected_components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def family(rng, n, words, edits):
    base = [rng.choice("ba ki lo mu ne ra si to ve zu".split()) + str(rng.randrange(50)) for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    rng = random.Random(width)
    texts = [None, "", "  \n", "one", "One", "a b c", "a b c", "a  B\tc", "Ä b", "ä b"]
    for words, edits in ((60, 3), (200, 6), (12, 1), (400, 10)):
        texts += list(family(rng, 25, words, edits))
    texts += ["long " + " ".join(str(k) for k in range(30_000))] * 2
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, bands string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width=width).collect()}
    want = brute(rows, width, 80)
    assert got == want
    assert max(Counter(c for _, c in want.values()).values()) > 5


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "alone here"), (2, None)], schema)
    got = sorted(repr((r.doc_id, r.component_id, r.kept)) for r in neardup.near_duplicates(rows).collect())
    assert got == sorted(map(repr, [(1, 1, True), (1, 1, True), (2, 2, True), (None, 1, False), (None, None, True)]))
    kept = neardup.drop_copies(rows.withColumn("count", F.lit("own"))).collect()
    assert sorted(repr((r.doc_id, r["count"])) for r in kept) == sorted(map(repr, [(1, "own"), (2, "own"), (None, "own"), (None, "own")]))


def test_rows_of_one_id_follow_their_own_texts(spark):
    a, b = ("one two three four five six seven eight nine ten " * 3).split(), ("eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3).split()
    near = lambda words: " ".join([*words, "more"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "something else of its own here"), (None, " ".join(b)), (None, "alone with no id at all here")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, 1, False), (None, None, True)], key=str)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(3)
    rows = list(enumerate(family(rng, 60, 80, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width=4).collect()}
    assert got == brute(rows, 4, 80)


def test_sketch_estimates_and_bounds():
    s = kernel.Sketcher(32, 4, 256, 1024)
    rng = np.random.default_rng(5)
    cut = kernel.most_differing_bits(0.8, 256)
    for share in (0.95, 0.9, 0.8):
        errors = []
        for _ in range(20):
            base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
            both = round(2000 * 2 * share / (1 + share))
            a, b = np.sort(base[:2000]), np.sort(np.concatenate([base[:both], base[2000 : 4000 - both]]))
            bits = int(np.bitwise_count((s.odd_sketch(s.minhash(a)) ^ s.odd_sketch(s.minhash(b))).view(np.uint64)).sum())
            assert bits <= cut
            errors.append(kernel.estimate(bits, 256, 1024) - share)
        assert abs(np.mean(errors)) < 0.03
    assert kernel.overlap(np.array([1, 3, 5], np.uint64), np.array([3, 4, 5, 9], np.uint64)) == 2


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "x long, y long")
    assert {r.node: r.component for r in connected_components(df, "x", "y").collect()} == {n: find(n) for n in root}
    assert connected_components(df.limit(0), "x", "y").count() == 0


def hamming_rows(codes, asked, k):
    out = {}
    for i, c in asked:
        best = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), j) for j, d in codes if j != i)[:k]
        out |= {(i, r): (j, d) for r, (d, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_top_k_is_exact(spark, block):
    rng = random.Random(2)
    codes = [(k, rng.getrandbits(64) - 2**63) for k in range(150)] + [(200 + k, 5) for k in range(60)] + [(300 + k, 5 ^ (1 << k)) for k in range(20)]
    df = spark.createDataFrame([(i, c, "x") for i, c in [*codes, codes[0], (None, 4), (999, None)]], "vec_id long, code long, rank string")
    got = hamming.top_k(df, df.where("vec_id % 10 = 0"), 7, row_block=block)
    want = hamming_rows(codes, [(i, c) for i, c in codes if i % 10 == 0], 7)
    assert {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in got.collect()} == want


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(1, 0), (2, 7)], "vec_id long, code long")
    assert [(r.query_id, r.neighbor_id, r.distance) for r in hamming.top_k(df, df.where("vec_id = 1"), 5).collect()] == [(1, 2, 3)]
    assert hamming.top_k(df.limit(0), df, 5).count() == 0 and hamming.top_k(df, df.limit(0), 5).count() == 0
    vectors = spark.createDataFrame([([0.5, -1.0, float("nan"), None, 2.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in vectors.select(hamming.sign_code(F.col("v"))).collect()] == [17, None, 0]
    with pytest.raises(Exception, match="more elements: 65"):
        spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(hamming.sign_code(F.col("v"))).collect()


@pytest.mark.parametrize("name", ["op1_multi_index_top_k", "op2_raked_mixture", "op3_chat_format"])
def test_query_matches_sql(name, same_as_sql):
    assert same_as_sql(queries.QUERIES[name], queries.ORACLES[name]) > 0


def test_op5_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5(spark, sf_dir).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, 4, 80).items()}


def test_limits_spare_what_lies_farther():
    rng = np.random.default_rng(4)
    codes, ids = rng.integers(-(2**63), 2**63, 4000), np.arange(4000)
    index, asked = hamming.SegmentIndex(codes), codes[:40] ^ 5
    every = np.bitwise_count((codes[None] ^ asked[:, None]).view(np.uint64)).astype(int)
    limits = np.sort(every, axis=1)[:, 5]
    who, what, far = hamming.search(index, ids, asked, 50, limits)
    for q in range(40):
        got = set(what[who == q].tolist())
        assert set(np.flatnonzero(every[q] <= limits[q]).tolist()) <= got and len(got) <= 50
        assert all(every[q, x] == d for x, d in zip(what[who == q], far[who == q], strict=True))
