"""Ids of candidates against dealing them one after the other."""

import random

from pyspark.sql import functions as F

from loomwright.operators import ingest


def plain(bases, taken):
    held, out = set(taken), []
    for base in bases:
        name, n = base, 1
        while name in held:
            n += 1
            name = f"{base}-{n}"
        held.add(name)
        out.append(name)
    return out


def run(spark, bases, taken, parts=4):
    rows = [(k * 7 + 3, b) for k, b in enumerate(bases)]
    order = rows[:]
    random.Random(1).shuffle(order)
    got = ingest.node_ids(spark.createDataFrame(order, "seq long, title_de string").repartition(parts), spark.createDataFrame([(t,) for t in taken], "id string"))
    return [r.node_id for r in got.orderBy("seq").collect()]


def test_ids_are_those_of_a_fold(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BUCKET", 4)
    for seed in range(3):
        rng = random.Random(seed)
        names = ["x", "x-2", "x-3", "x-2-2", "x-5", "x-02", "x-1", "y", "y-4", "z-2"]
        bases = [rng.choice(names[: rng.randint(2, len(names))]) for _ in range(rng.randint(1, 40))]
        taken = [n for n in [*names, "x-4", "x-6", "x-2-3", "y-2", "x-12", "y-99999999999999999999"] if rng.random() < 0.35]
        assert run(spark, bases, taken) == plain(bases, taken), (bases, taken)


def test_one_slug_of_many_candidates(spark):
    bases = ["konzept"] * 12_000 + ["konzept-40", "konzept-11500", "konzept-20000"]
    random.Random(2).shuffle(bases)
    taken = ["konzept", *(f"konzept-{k}" for k in range(2, 3000, 2))]
    assert run(spark, bases, taken, 8) == plain(bases, taken)


def test_no_task_holds_a_slug(spark):
    rows = spark.range(20_000).select(F.col("id").alias("seq"), F.lit("same").alias("title_de"))
    got = ingest.node_ids(rows, spark.createDataFrame([], "id string"))
    assert got.select("node_id").distinct().count() == 20_000 and got.where("node_id = 'same-20000'").count() == 1
    assert ingest.node_ids(rows.limit(0), spark.createDataFrame([("a",)], "id string")).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan
