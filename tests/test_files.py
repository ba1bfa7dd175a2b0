"""Files with names of their own, and tables replaced as one: what failures leave behind."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwright.functions.folders import written
from loomwright.operators import index
from loomwright.schemas import SIDECAR
from loomwright.sources import files, snapshots
from loomwright.sources.named_files import read_files, write_files


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "name string, text string").repartition(3)


def test_files_have_their_names_and_bytes(spark, tmp_path):
    out = tmp_path / "out"
    write_files(rows(spark, ("a.md", "ä\r\nb\n"), ("q/ü b.md", ""), ("c.md", None), ("long.md", "x" * 3_000_000)), f"file://{out}")
    assert names(out) == ["a.md", "c.md", "long.md", "q/ü b.md"]
    assert (out / "a.md").read_bytes() == "ä\r\nb\n".encode() and (out / "c.md").read_bytes() == b"" and len((out / "long.md").read_bytes()) == 3_000_000
    write_files(rows(spark, ("a.md", "new")), str(out))
    assert names(out) == ["a.md", "c.md", "long.md", "q/ü b.md"] and (out / "a.md").read_text() == "new"
    write_files(rows(spark, ("a.md", "last"), ("d.md", "d")), str(out), overwrite=True)
    assert names(out) == ["a.md", "d.md"]
    write_files(rows(spark).limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or names(tmp_path / "none") == []


@pytest.mark.parametrize("bad", ["../x.md", "/x.md", "a//b.md", ".hidden", "_x", "", None])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    out = tmp_path / "out"
    write_files(rows(spark, ("kept.md", "old")), str(out))
    with pytest.raises(Exception, match="not a name"):
        write_files(rows(spark, *[(f"n{k}.md", "x") for k in range(30)], (bad, "x")), str(out))
    assert names(out) == ["kept.md"] and (out / "kept.md").read_text() == "old"


def test_names_come_once(spark, tmp_path):
    with pytest.raises(Exception, match="twice"):
        write_files(rows(spark, ("a.md", "1"), ("a.md", "2"), ("b.md", "3")), str(tmp_path / "out"))
    assert names(tmp_path / "out") == []


def test_a_failed_rebuild_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    nodes = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.expr("cast(array() as array<struct<target:string, relation:string, confidence:double>>)").alias("links"), F.array(F.lit("t")).alias("themes"))
    with pytest.raises(LookupError):
        snapshots.read(spark, root, "nodes")
    assert index.rebuild(root, nodes(3), "one") == 1
    old = snapshots.read(spark, root, "node_themes")
    # the nodes are written, the themes fail
    broken = nodes(9).withColumn("themes", F.when(F.col("id") == "8", F.raise_error(F.lit("no themes")).cast("array<string>")).otherwise(F.col("themes")))
    with pytest.raises(Exception, match="no themes"):
        snapshots.publish(root, {"nodes": nodes(9), "node_themes": broken.select("id", F.explode("themes"))}, "two")
    assert snapshots.current(spark, root).stamp == "one" and snapshots.read(spark, root, "nodes").count() == 3
    assert index.rebuild(root, nodes(5), "three") == 2
    assert snapshots.read(spark, root, "nodes").count() == 5 and snapshots.read(spark, root, "nodes", version=1).count() == 3 and old.count() == 3


def test_sidecars_keep_constant_keys(spark, tmp_path):
    side = spark.createDataFrame([], SIDECAR)
    side = spark.createDataFrame([("s1", *[None] * (len(side.columns) - 1)), ("s2", "p", "h", None, 3, "m", "v", 2, ".png", *[None] * 5, 4)], side.schema)
    import json

    got = {r.source_id: json.loads(r.json) for r in files.sidecar_json(side).collect()}
    assert list(got["s1"]) == list(files.ALWAYS) and set(got["s1"].values()) == {"s1", None}
    assert list(got["s2"]) == [*files.ALWAYS, "artifact_suffix", "page"]
    files.write_sidecars(side, str(tmp_path / "side"))
    assert {r.source_id: r.page for r in files.read_sidecars(spark, str(tmp_path / "side")).collect()} == {"s1": None, "s2": 4}


def test_node_files_are_parsed_once_and_one_id_may_be_in_two_queues(spark, tmp_path, monkeypatch):
    from loomwright.plans.file_queries import _documents_as_nodes
    from loomwright.sources import nodes

    docs = spark.createDataFrame([(k, f"s{k}", "de", "t") for k in range(40)], "doc_id long, source string, lang string, text string")
    monkeypatch.setattr("loomwright.plans.file_queries.table", lambda *_: docs)
    rows = _documents_as_nodes(spark, "")
    nodes.write_nodes(rows, f"file://{tmp_path}/nodes")
    got = nodes.read_nodes(spark, f"file://{tmp_path}/nodes")
    # what is sorted is a table of parsed rows: no Python runs above it
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and got.count() == 40
    twice = rows.where("id = 'n1'")
    staged = twice.withColumn("source_id", F.lit("a")).unionByName(twice.withColumn("source_id", F.lit("b")))
    nodes.write_queue(staged, f"file://{tmp_path}/queue")
    assert (tmp_path / "queue/a/n1.md").read_text() == (tmp_path / "queue/b/n1.md").read_text() == (tmp_path / "nodes/n1.md").read_text()


def test_texts_that_are_empty_or_not_there_are_read_back(spark, monkeypatch):
    from hashlib import sha256

    from loomwright.plans import file_queries

    texts = {1: "ein text", 2: "", 3: None, None: "no id"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(file_queries, "table", lambda *_: docs)
    got = {(r["name"], r.digest) for r in file_queries.raw_texts_read_back(spark, "").collect()}
    assert got == {(k and str(k), None if t is None else sha256(t.encode()).hexdigest()) for k, t in texts.items()}


def test_files_are_listed_by_tasks_and_named_as_spark_names_them(spark, tmp_path):
    odd = ["a.txt", "ü b.txt", "50%[x].txt", "q#1.txt", "n.md"]
    for name in [*odd, ".hidden.txt", "_x.txt", "sub/in.txt"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    for path, suffix in ((f"file://{tmp_path}", ""), (str(tmp_path), ".txt"), (f"file:{tmp_path}/n.md", "")):
        got = read_files(spark, path, suffix)
        assert got.inputFiles() == [] and got.rdd.getNumPartitions() <= 64
        want = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
        rows = {tuple(r) for r in got.collect()}
        assert rows == {tuple(r) for r in want.select("path", "content").collect()} and rows
    assert {r.path.rsplit("/", 1)[-1] for r in read_files(spark, f"file://{tmp_path}/[an].*").collect()} == {"a.txt", "n.md"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_files(spark, f"file://{tmp_path}/none")


def test_names_of_files_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """They are rows of a table that tasks write and move by; what was there before is left out by a join."""
    from loomwright.sources import named_files

    out, kept = f"file://{tmp_path}/out", []
    monkeypatch.setattr(named_files, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    many = lambda n, text: spark.range(n).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/"), "id", F.lit(".md")).alias("name"), F.lit(text).alias("text"))
    write_files(many(300, "old"), out)
    write_files(many(100, "new"), out, overwrite=True)
    assert [df.select("name").distinct().count() for df in kept] == [300, 100]
    assert names(tmp_path / "out") == sorted(f"d{k % 3}/{k}.md" for k in range(100))
    assert {p.read_text() for p in (tmp_path / "out").rglob("*.md")} == {"new"}
