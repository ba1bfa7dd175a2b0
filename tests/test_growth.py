"""What grows with the input is not sent to the driver, shuffled whole or made twice."""

import json
import re

from pyspark.sql import functions as F

from loomwright.operators import adjudicate_run, dedup, embed, ingest_run, kept_index, level, merge, models, steps


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_meet_their_nodes_without_a_broadcast(spark):
    """Rows made of small files' columns are larger than the files: no side with a row for each pair is broadcast."""
    ids = spark.range(20).select(F.col("id").cast("string").alias("k"))
    row = lambda letter: ids.select(F.concat(F.lit(letter), "k").alias("id"), F.lit("t").alias("title_de"), F.lit("t").alias("title_en"), F.lit("vocab").alias("type"), F.lit("A1").alias("cefr"), F.array("k").alias("source_ids"), F.lit("b").alias("body_md"), F.lit(1).alias("version"))
    pairs = ids.select(F.concat(F.lit("c"), "k").alias("candidate"), F.concat(F.lit("n"), "k").alias("other"), F.lit(1).alias("rank"), F.lit(0.99).alias("similarity"), F.lit("t").alias("tier"), F.lit("b").alias("band"))
    candidates = row("c").drop("version").withColumns({"source_id": F.lit("s"), "path": F.lit("q")})
    got = adjudicate_run.propose_all(pairs, candidates, row("n"), None, ids.select(F.col("k").alias("source_id"), F.lit("x").alias("text")), lambda prompts: [("", "stop")] * len(prompts), "m", "p", F.current_timestamp())
    assert "Broadcast" not in plan(got.proposals)
    assert {r["kind"] for r in got.proposals.collect()} == {"merge"} and got.failed.isEmpty()


def test_fixed_parts_of_prompts_are_neither_shuffled_nor_kept(spark, monkeypatch):
    wrote, written = [], models.written
    monkeypatch.setattr(models, "written", lambda df, name: wrote.append(df) or written(df, name))
    client = lambda prompts: [('{"cefr": "A1"}' if "refused" in p or "x0" in p else "no", "stop") for p in prompts]
    rows = spark.range(4).select("id", F.concat(F.lit("x"), F.col("id") % 2).alias("t"))
    got = {r["id"]: (r["value"]["cefr"], r["attempts"]) for r in steps.run(rows, steps.TIEBREAK, F.col("t"), client, "m").collect()}
    assert got == {0: ("A1", 1), 1: ("A1", 2), 2: ("A1", 1), 3: ("A1", 2)}
    # what is grouped is what the messages are made of
    grouped = re.search(r"first\((prompt#\d+)", plan(wrote[0]))[1]
    assert f"content, {grouped})" in plan(wrote[0])
    assert sorted(r["prompt"] is None for r in wrote[0].collect()) == [False, True]
    assert all(r["prompt"] is None for r in wrote[1].collect())


def test_sources_of_one_name_keep_their_own_texts(spark):
    client = lambda prompts: [(json.dumps({"candidates": []}), "stop")] * len(prompts)
    sources = spark.createDataFrame([("a.txt", "one"), ("a.txt", "two, longer"), ("a.txt", "one"), ("b.txt", "one")], "name string, content string")
    got = ingest_run.ingest_texts(sources, client, "m", "p", "20260101", F.current_timestamp(), None, spark.createDataFrame([], "id string"))
    assert sorted((r["source_id"][:10], r["text"]) for r in got.raw.collect()) == [("20260101-a", "one"), ("20260101-a", "two, longer"), ("20260101-b", "one")]
    assert sorted((r["original_path"], r["chars"]) for r in got.sidecars.collect()) == [("a.txt", 3), ("a.txt", 11), ("b.txt", 3)]


def test_texts_to_embed_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        made.add(1)
        return f"text {i % 3}"

    nodes = spark.range(9).select("id", F.lit("t").alias("title_de"), body("id").alias("body_md"))
    key = embed.vector_key("m", embed.T.embed_text(F.lit("t"), F.lit("text 0")))
    cache = spark.range(1).select(key.alias("key"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    got = embed.vectors_for(nodes, "m", cache, lambda texts: [[float(len(t)), 0.0] for t in texts], 2)
    assert sorted((r["node_id"], r["computed"]) for r in got.collect()) == [(i, i % 3 > 0) for i in range(9)]
    assert made.value == 9


def test_verdicts_are_read_once(spark):
    rows = [("a", "x", 1, "DISTINCT"), ("a", "y", 2, "SAME"), ("b", "x", 1, "DISTINCT_RELATED"), ("b", "y", 1, "DISTINCT"), ("c", "z", 1, None)]
    verdicts = spark.createDataFrame(rows, "candidate string, other string, rank int, outcome string")
    got = merge.fates(verdicts)
    assert plan(got).count("Exchange") == 1
    assert sorted((r["candidate"], r["other"] or "", r["outcome"], r["kind"]) for r in got.collect()) == [("a", "y", "SAME", "merge"), ("b", "", "DISTINCT", "create"), ("b", "x", "DISTINCT_RELATED", "link"), ("c", "", "DISTINCT", "create")]


def test_words_of_texts_are_not_shuffled_to_a_short_list(spark):
    """Words are looked up where their text is read: a row for each word is not sent anywhere."""
    nodes = spark.createDataFrame([("1", "der Titel", "rest der", "A1", None, ["der", "tisch"], "s")], "id string, title_de string, body_md string, cefr string, cefr_basis string, lemmas array<string>, source string")
    words = level.word_levels(spark.createDataFrame([("der", "B1"), ("tisch", "A2")], "lemma string, level string"))
    got = level.levels(nodes, words, keep=("source",))
    assert [tuple(r) for r in got.select("id", "source", "derived", "derived_basis").collect()] == [("1", "s", "B1", "goethe:b1(der)")]
    assert "SortMergeJoin [lemma" not in plan(level.levels(nodes, words)) and "BroadcastHashJoin [lemma" in plan(level.levels(nodes, words))


def test_pairs_and_ids_of_duplicates_are_never_broadcast(spark):
    """Pairs of copies grow with the square of a group, and their file stays small."""
    rows = spark.createDataFrame([(k, f"{'ein text, den viele haben' if k % 3 else 'ganz anders'} {'und' if k % 2 else 'ond'} hier") for k in range(12)], "id long, text string")
    vectors = rows.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    seen = rows.select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    joins = lambda df: [x for x in plan(df).splitlines() if "Broadcast" in x and "Join" in x]
    assert joins(dedup.near_exact_pairs(rows)) == joins(kept_index.duplicate_classes(rows)) == []
    got = dedup.semantic_pairs(vectors, vectors, seen, low=0.0, k=3)
    # what is broadcast is the place of each cell, of which there are 1,024 at most
    assert [x for x in joins(got) if "[cell" not in x] == []
    assert got.join(seen, ["left_id", "right_id"]).count() == 0 < got.count()
