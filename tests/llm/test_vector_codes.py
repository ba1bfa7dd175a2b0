"""Product codes against a version that evaluates every entry in plain integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import queries, vector_codes
from tests.conftest import rows_of

NAME = "op12_screened_product_codes"


def plain(vectors, parts=16, entries=64, rounds=2):
    """``{id: (code, error)}`` and the codebooks of ``[(id, vector)]``, with Python's integers."""
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(ints[0][1]) // parts
    cut = [(i, [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]) for i, v in ints]
    seeds = {}
    for i, v in sorted(cut, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        if i is not None:
            seeds.setdefault(i, v)
    seeds = [v for _, v in list(seeds.items())[:entries]]
    books = [[v[p] for v in seeds] for p in range(parts)]

    def best(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            near = {}
            for _, v in cut:
                near.setdefault(best(p, v[p])[1], []).append(v[p])
            books[p] = [tuple(sum(x) // len(near[k]) for x in zip(*near[k], strict=True)) if k in near else e for k, e in enumerate(books[p])]
    codes = []
    for i, v in cut:
        found = [best(p, v[p]) for p in range(parts)]
        codes.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(codes, key=str), books


def test_query_against_sql(spark, sf_dir, duck):
    got, want = queries.QUERIES[NAME](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[NAME]).df()
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns)) and len(got) > 0


def test_plain_version(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = plain(rows)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out = queries.QUERIES[NAME](spark, sf_dir).collect()
    assert sorted([(r.vec_id, r.code, r.error) for r in out], key=str) == want and {r.codebooks_sha256 for r in out} == {digest}


@pytest.mark.parametrize("size", [3, 300, (1 << 23)])
def test_screening_is_exact(size):
    rng = np.random.default_rng(size)
    for width in (1, 4, 48):
        rows, book = rng.integers(-size, size, (200, width)), rng.integers(-size, size, (64, width))
        book[40:] = book[:24] + rng.integers(-1, 2, (24, width))  # near ties
        book[10] = book[3]
        rows[:20] = book[:20]
        apart = ((rows[:, None, :] - book[None]) ** 2).sum(2)
        at, least = vector_codes.nearest(rows, book)
        assert (least == apart.min(1)).all() and (at == apart.argmin(1)).all()
    # offsets far larger than what tells entries apart
    rows, book = (1 << 23) + rng.integers(0, 3, (300, 8)), (1 << 23) + rng.integers(0, 3, (64, 8))
    apart = ((rows[:, None, :] - book[None]) ** 2).sum(2)
    at, least = vector_codes.nearest(rows, book)
    assert (least == apart.min(1)).all() and (at == apart.argmin(1)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [((k * 7 + j * 3) % 11 - 5) / 4 for j in range(16)], k % 3 if k % 4 else None) for k in range(40)]
    odd = [(100, None, 1), (101, [1.0] * 15 + [None], 1), (102, [nan] + [0.0] * 15, 1), (103, [0.0] * 15 + [-inf], 2), (None, [0.25] * 16, None), (3, [9.0] * 16, 1), (3, [9.0] * 16, 1), (3, [-9.0] * 16, 2)]
    schema = "vec_id long, embedding array<float>, label int"
    vectors = spark.createDataFrame(good + odd, schema).withColumns({"error": F.lit("own"), "code": F.lit(1), "id": F.lit(0)})
    codes, books = vector_codes.compress(vectors)
    got = codes.collect()
    want, plain_books = plain([(i, v) for i, v, _ in good + odd])
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=str) == want
    assert books.tolist() == [[list(e) for e in p] for p in plain_books]
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got) and None in sums
    for part in ([], odd[:4]):
        codes, books = vector_codes.compress(spark.createDataFrame(part, schema))
        assert codes.columns == ["vec_id", "label", "code", "error", "label_error"] and codes.collect() == [] and books.size == 0
    alone = vector_codes.compress(spark.createDataFrame(odd[4:5], schema))[0].collect()
    assert [(r.code, r.error, r.label_error) for r in alone] == [("", 0, 0)]
    for wrong in ([(1, [1.0] * 15, 1)], [(1, [70000.0] * 16, 1)], [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]):
        with pytest.raises(Exception, match="width|or more"):
            vector_codes.compress(spark.createDataFrame(wrong, schema))[0].collect()
