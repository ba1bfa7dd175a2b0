"""The jobs over growing copies of the tables, after failures, and from their command line."""

import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, report_levels, watch_duplicates
from loomwright.operators import kept_index
from tests.conftest import rows_of

SCHEMA = "doc_id long, text string, lang string"


def links_of(spark, out):
    return sorted((r.kind, r.left_id, r.right_id, round(r.similarity, 9)) for r in watch_duplicates.links(spark, out).collect())


@pytest.fixture
def parts(spark, sf_dir, tmp_path):
    """The documents in three deliveries, by id, with copies and near copies across them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = docs.where("doc_id < 20").select((F.col("doc_id") + 100_000).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" end"))).alias("text"), "lang")
    odd = spark.createDataFrame([(200_000, None, None), (200_001, "", "x"), (None, "no id", None), (200_002, "word " * 30_000, "x"), (200_003, "ab", "x"), (200_004, "AB ", "x")], SCHEMA)
    every = docs.unionByName(extra).unionByName(odd)
    return [every.where("doc_id < 80"), every.where("doc_id between 80 and 99999 or doc_id is null"), every.where("doc_id >= 100000")]


def test_growing_input_equals_one_run(spark, parts, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    taken = []
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        taken.append(watch_duplicates.run(spark, source, out, checkpoint))
        again = watch_duplicates.run(spark, source, out, checkpoint)
        assert again == taken[-1] | {"batches": 0}
    assert [t["batches"] for t in taken] == [1, 1, 1]
    whole = f"file://{tmp_path}/whole"
    watch_duplicates.run(spark, source, whole, f"file://{tmp_path}/whole-checkpoint")
    assert links_of(spark, out) == links_of(spark, whole)
    got = links_of(spark, out)
    assert ("copy", 0, 100_000, 1.0) in got and ("copy", 200_000, 200_001, 1.0) in got and ("copy", 200_003, 200_004, 1.0) in got
    assert {k for k, *_ in got} == {"copy", "near-exact"} and any(k == "near-exact" and a < 80 and b >= 100_000 for k, a, b, _ in got)
    assert spark.read.parquet(f"{out}/links").select("batch").distinct().count() == 3


def test_later_batches_read_no_old_text(spark, parts, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    parts[0].coalesce(1).write.parquet(source)
    watch_duplicates.run(spark, source, out, checkpoint)
    # the first delivery is gone from the source; its texts are still known
    for path in Path(f"{tmp_path}/in").glob("*.parquet"):
        path.unlink()
    parts[2].coalesce(1).write.mode("append").parquet(source)
    watch_duplicates.run(spark, source, out, checkpoint)
    assert ("copy", 0, 100_000, 1.0) in links_of(spark, out)


def test_a_batch_taken_again_gives_the_same(spark, parts, tmp_path):
    clean, broken = f"file://{tmp_path}/clean", f"file://{tmp_path}/broken"
    for out in (clean, broken):
        watch_duplicates.take(parts[0], 0, out, 0.85)
    watch_duplicates.take(parts[2], 1, clean, 0.85)
    # the second batch had failed half-way, with other sets and without links
    watch_duplicates.put(kept_index.new_sets(kept_index.keyed(parts[2].select(F.col("doc_id").alias("id"), "text").limit(5)), spark.createDataFrame([], kept_index.SETS)), broken, "sets", 1)
    for _ in range(2):
        watch_duplicates.take(parts[2], 1, broken, 0.85)
    assert links_of(spark, clean) == links_of(spark, broken)
    shutil.rmtree(f"{tmp_path}/broken/links")
    watch_duplicates.take(parts[0], 0, broken, 0.85)
    assert len(links_of(spark, broken)) < len(links_of(spark, clean))


def test_levels_are_rewritten_as_a_whole(spark, sf_dir, tmp_path):
    out, lists = f"file://{tmp_path}/out", tmp_path / "lists"
    lists.mkdir()
    (lists / "a1.txt").write_text("# words\nthe\nder\n\n")
    (lists / "c1.txt").write_text("que\n")
    source = f"{sf_dir}/documents.parquet"
    before = report_levels.run(spark, source, out, str(lists), [["artikel", "A2", r"\bder\b"]])
    first = report_levels.read_proposals(spark, out).toPandas()
    assert report_levels.run(spark, source, out, str(lists), [["artikel", "A2", r"\bder\b"]]) == before
    again = report_levels.read_proposals(spark, out).toPandas()
    assert rows_of(first, sorted(first.columns)) == rows_of(again, sorted(first.columns)) and before["proposals"] == len(first) > 0
    assert {"A1", "C1"} <= set(first.cefr)
    summary = report_levels.read_summary(spark, out).toPandas()
    assert summary.texts.sum() == before["texts"] and summary.changes.sum() == before["proposals"]
    # a level that nothing is proposed for any more has no partition
    (lists / "c1.txt").write_text("")
    report_levels.run(spark, source, out, str(lists), [["artikel", "A2", r"\bder\b"]])
    assert "C1" not in {r.cefr for r in report_levels.read_proposals(spark, out).select("cefr").collect()}


def test_levels_of_odd_rows(spark, tmp_path):
    rows = [(1, "Das Perfekt\nmore", "s", "A1", None), (2, None, None, None, "llm:extraction"), (3, "", "s", "B1", "human:seed"), (None, "x", "s", "A1", None), (4, "w " * 100_000, "s", "A2", "llm:x")]
    for part, n in ((rows, 4), ([], 0)):
        source, out = f"file://{tmp_path}/in{n}", f"file://{tmp_path}/out{n}"
        spark.createDataFrame(part, "doc_id long, text string, source string, cefr string, cefr_basis string").write.parquet(source)
        done = report_levels.run(spark, source, out, f"{tmp_path}/none", everything=False)
        assert done["texts"] <= n and done["proposals"] == report_levels.read_proposals(spark, out).count()
    got = {r.candidate: r.cefr for r in report_levels.read_proposals(spark, f"file://{tmp_path}/out4").collect()}
    assert got["1"] == "A2"


def test_command_line(monkeypatch, tmp_path):
    seen = {}

    class Session:
        def stop(self):
            seen["stopped"] = True

    class Builder:
        def appName(self, name):  # noqa: N802
            seen["name"] = name
            return self

        def getOrCreate(self):  # noqa: N802
            return Session()

    monkeypatch.setattr(common, "SparkSession", type("S", (), {"builder": Builder()}))
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"out": "there", "threshold": 0.9}))
    said = common.main("watch_duplicates", lambda spark, **k: k, ["--config", str(config), "--source", "here"])
    assert said == {"source": "here", "out": "there", "checkpoint": "duplicates-checkpoint", "threshold": 0.9}
    assert seen == {"name": "watch_duplicates", "stopped": True}
    with pytest.raises(RuntimeError):
        common.main("report_levels", lambda spark, **k: (_ for _ in ()).throw(RuntimeError("no")), [])
