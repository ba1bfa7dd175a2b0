"""Nearest vectors through pivots against all pairs, and how many pairs are compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators.pivots import PivotIndex

SCHEMA = "id long, vector array<float>"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def plain(ids, vectors, asked, k, least=None):
    vectors = vectors.astype(np.float32).astype(float)
    scores = np.round(vectors @ vectors.T, 6)
    out = {}
    for q in asked:
        best = sorted((-scores[q, j], int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])[:k]
        out |= {(int(ids[q]), r): (j, -s) for r, (s, j) in enumerate(best, 1) if least is None or -s >= least}
    return out


def got(found):
    return {(r.id, r["rank"]): (r.other, r.similarity) for r in found.collect()}


def clustered(n, dim=48, centres=40, spread=0.04, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] / np.linalg.norm(c, axis=1).mean() + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("least", [None, 0.87])
def test_clusters_are_pruned(spark, least):
    vectors = clustered(2000)
    ids = np.arange(2000)
    rows = frame(spark, ids, vectors)
    index = PivotIndex(rows)
    assert got(index.nearest(rows, 10, least=least)) == plain(ids, vectors, ids, 10, least)
    kth = index.nearest(rows, 10).where("rank = 10").select("id", F.col("similarity").alias("kth"))
    sizes = dict(enumerate(index.cells[:, 4]))
    visited = [index.visits(rows, 10, least).groupBy("cell").count().collect(), index.visits(rows, 10, least, kth).groupBy("cell").count().collect()]
    compared = sum(sizes[r.cell] * r["count"] for rows in visited for r in rows)
    assert compared < 2000**2 / 10


@pytest.mark.parametrize("pivots", [1, 3, 200])
def test_any_vectors(spark, monkeypatch, pivots):
    monkeypatch.setattr("loomwright.operators.pivots.PART_ROWS", 16)
    rng = np.random.default_rng(pivots)
    vectors = np.concatenate([rng.normal(size=(120, 8)), np.zeros((3, 8)), np.tile(rng.normal(size=(1, 8)), (70, 1)), 50 * rng.normal(size=(20, 8))])
    ids = rng.permutation(1000)[: len(vectors)]
    rows = frame(spark, ids, vectors)
    some = rows.where("id % 2 = 0")
    asked = [q for q in range(len(ids)) if ids[q] % 2 == 0]
    assert got(PivotIndex(rows, pivots).nearest(some, 7)) == plain(ids, vectors, asked, 7)


def test_little_and_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], SCHEMA).withColumns({"cell": F.lit("own"), "angle": F.lit(1)})
    assert got(PivotIndex(rows).nearest(rows, 5)) == {(1, 1): (2, 0.0), (2, 1): (1, 0.0)}
    assert PivotIndex(rows.limit(0)).nearest(rows, 5).count() == 0 and PivotIndex(rows).nearest(rows.limit(0), 5).count() == 0
    assert PivotIndex(rows.where("id = 3")).nearest(rows, 5).count() == 0


def test_queries_are_sent_to_blocks_not_cells(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(3000)
    rows = frame(spark, ids, vectors)
    index = PivotIndex(rows)
    # evenly spread: all of the fifty cells are visited, but a block of them answers once
    assert index.visits(rows, 10, 0.2).count() + index.visits(rows, 10, 0.2, rows.select("id", F.lit(0.3).alias("kth"))).count() > 3000 * 40
    first, parts, most = index._blocks()
    blocks = int((first + parts).max())
    assert blocks <= 3 and most >= 1024
    assert index.answers(rows, 10, 6, best=rows.select("id", F.lit(-1.0).alias("kth"))).count() <= 3000 * 10 * blocks
    assert got(index.nearest(rows.where("id < 40"), 10)) == plain(ids, vectors, range(40), 10)
