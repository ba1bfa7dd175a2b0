"""Balanced shards: the law and the places for any groups, and how few groups are cut."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard_hint string"


def placed(spark, texts, n_shards=24, **more):
    rows = [(k, t, "own") for k, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")
    return sharding.balanced_shards(docs, sharding.text_key(F.col("text")), n_shards, keep=("doc_id", "text"), **more).collect()


def lawful(rows, n, n_shards):
    """Counts at most one apart, and slots without gaps."""
    assert len(rows) == n == len({r.doc_id for r in rows})
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < n_shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def spans(rows):
    """Shards that each text with copies is in, and its size."""
    found = defaultdict(list)
    for r in rows:
        found[r.text or ""].append(r.shard)
    return {t: (len(set(s)), len(s)) for t, s in found.items() if len(s) > 1}


def test_groups_stay_together(spark):
    rng = random.Random(1)
    texts = [f"single {k}" for k in range(900)]
    for g in range(150):
        texts += [f"group {g}"] * rng.choice([2, 2, 2, 3, 5, 9])
    rows = placed(spark, texts)
    lawful(rows, len(texts), 24)
    assert all(n == 1 for n, _ in spans(rows).values())


def test_a_group_larger_than_shards(spark):
    # a third of all rows is one text: it needs eight shards and gets hardly more
    texts = ["giant"] * 800 + [f"pair {k // 2}" for k in range(400)] + [f"single {k}" for k in range(1200)]
    rows = placed(spark, texts)
    lawful(rows, len(texts), 24)
    found = spans(rows)
    assert found.pop("giant")[0] <= 10
    assert sum(n > 1 for n, _ in found.values()) <= 4


def test_no_room_but_by_exchange(spark):
    # every document has copies, so nothing fills gaps
    texts = [f"group {k // 4}" for k in range(960)]
    rows = placed(spark, texts, 8)
    lawful(rows, 960, 8)
    start = placed(spark, texts, 8, rounds=0)
    lawful(start, 960, 8)
    assert all(n == 4 for n, _ in spans(start).values())
    # hardly any of 240 groups is left in several shards
    assert sum(n > 1 for n, _ in spans(rows).values()) < 40


@pytest.mark.parametrize("texts", [[], ["a"], ["a", "a"], [None, "", "b", None], ["x"] * 50, [f"t{k}" for k in range(50)], ["long " * 200_000, "b"]])
def test_odd_tables(spark, texts):
    rows = placed(spark, texts)
    lawful(rows, len(texts), 24)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", "own")] * 30 + [(None, "b", "own")] * 30 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"hub": F.lit(1), "row": F.lit(2), "kept": F.lit(3)})
    out = sharding.balanced_shards(docs, F.when(F.col("text") == "a", "k"), 4, keep=("doc_id", "hub", "row", "kept", "shard_hint")).collect()
    assert len(out) == 63 and sorted(Counter(r.shard for r in out).values()) == [15, 16, 16, 16]
    assert all((r.hub, r.row, r.kept) == (1, 2, 3) for r in out)
    with pytest.raises(ValueError):
        sharding.balanced_shards(docs.withColumn("slot", F.lit(1)), F.lit("k"), 4, keep=("slot",))


def test_query(spark, sf_dir):
    got = queries.QUERIES["op11_balanced_label_shards"](spark, sf_dir).toPandas()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    counts = got.groupby("shard").doc_id.count()
    assert set(counts.index) == set(range(24)) and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got.assign(text=got.doc_id.map(docs)).groupby("text").shard.nunique()
    assert (groups == 1).all()
