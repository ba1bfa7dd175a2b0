"""Ledgers, ingest, merges, model steps, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomwright.operators import index, ingest, ledger, merge, models
from loomwright.schemas import USAGE
from loomwright.sources import files
from loomwright.streaming import watch


def test_cost(spark):
    df = spark.createDataFrame([(10**6, 0, 10**6, 0.6, 0.11, 2.2), (10**6, 500_000, 0, 0.6, 0.11, 2.2), (100, 200, 0, 1.0, None, 0.0), (1, 0, 1, None, None, None)], "p long, c long, o long, i double, ci double, r double")
    got = [r[0] for r in df.select(ledger.cost(*(F.col(c) for c in ("p", "c", "o", "i", "ci", "r")))).collect()]
    assert got[:3] == pytest.approx([2.8, 0.355, 0.0002]) and got[3] is None


def test_usage(spark, tmp_path):
    assert files.read_usage(spark, f"file://{tmp_path}/none").count() == 0
    row = dict.fromkeys([c.split()[0] for c in USAGE.replace("\n", " ").split(", ")])
    rows = [row | {"ts": t, "step": "a", "cached": c, "prompt_tokens": 5, "cost_usd": u, "saved_usd": None} for t, c, u in (("2026-07-01T1", True, 0.0), ("2026-07-01T2", True, 0.0), ("2026-07-05T1", False, None))]
    files.append_ledger(spark.createDataFrame(rows, USAGE), f"file://{tmp_path}/log")
    usage = files.read_usage(spark, f"file://{tmp_path}/log")
    total = ledger.usage_totals(usage).first()
    assert (total.calls, total.hits, total.unpriced_calls, total.prompt_tokens) == (3, 2, 1, 15) and total.hit_rate == pytest.approx(2 / 3)
    assert {(r.name, r.calls) for r in ledger.usage_totals(usage, "day").collect()} == {("2026-07-01", 2), ("2026-07-05", 1)}
    assert ledger.usage_totals(ledger.since(usage, "2026-07-02")).first().calls == 1
    assert ledger.usage_totals(usage.limit(0)).first().calls == 0


def test_bad_ledger_fails(spark, tmp_path):
    assert files.read_decisions(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "d.jsonl").write_text('{"winner": "a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_decisions(spark, f"file://{tmp_path}/d.jsonl").collect()


def test_node_ids_fill_gaps(spark):
    rows = spark.createDataFrame([(1, "Haus"), (2, "haus"), (3, "Haus 2"), (4, "Haus"), (5, "!")], "seq long, title_de string")
    taken = spark.createDataFrame([("haus",), ("haus-3",)], "id string")
    got = {r.seq: r.node_id for r in ingest.node_ids(rows, taken).collect()}
    assert got == {1: "haus-2", 2: "haus-4", 3: "haus-2-2", 4: "haus-5", 5: "konzept"}


def test_source_ids_widen(spark):
    rows = spark.createDataFrame([("a.txt", "eins"), ("b/a.txt", "eins"), ("c.txt", "zwei")], "name string, content string")
    first = ingest.source_ids(rows, "20260101").collect()
    ids = {r.name: r.source_id for r in first}
    assert ids["c.txt"].startswith("20260101-c-") and len(ids["c.txt"]) == len("20260101-c-") + 8
    clash = spark.createDataFrame([(ids["c.txt"], "other")], "source_id string, digest string")
    again = {r.name: (r.source_id, r.is_new) for r in ingest.source_ids(rows, "20260101", clash).collect()}
    assert len(again["c.txt"][0]) == len("20260101-c-") + 12 and again["c.txt"][1]
    same = spark.createDataFrame([(ids["c.txt"], [r.digest for r in first if r.name == "c.txt"][0])], "source_id string, digest string")
    assert {r.name: r.is_new for r in ingest.source_ids(rows, "20260101", same).collect()}["c.txt"] is False


def test_fates(spark):
    rows = [("x", "a", 1, "DISTINCT_RELATED"), ("x", "b", 2, "OVERLAP"), ("x", "c", 3, "SAME"), ("y", "a", 1, "DISTINCT_RELATED"), ("z", "a", 1, "DISTINCT")]
    got = {(r.candidate, r.other, r.kind) for r in merge.fates(spark.createDataFrame(rows, "candidate string, other string, rank int, outcome string")).collect()}
    assert got == {("x", "b", "merge"), ("y", "a", "link"), ("y", None, "create"), ("z", None, "create")}


def test_same_body(spark):
    df = spark.createDataFrame([("Text\n", "## Examples\n- Neu. (new)"), ("## Examples\n- Alt!", "## Examples\n- alt\n- Neu"), ("T", "kein")], "w string, l string")
    got = [r[0] for r in df.select(merge.same_body(F.col("w"), F.col("l"))).collect()]
    assert got == ["Text\n\n## Examples\n- Neu.\n", "## Examples\n- Alt!\n- Neu\n", "T"]


def test_cap(spark):
    done = spark.createDataFrame([("a", True, "OVERLAP")] * 5 + [("a", True, "SAME"), ("b", False, "OVERLAP")], "winner string, approved boolean, outcome string")
    nodes = spark.createDataFrame([("a", 1), ("b", 3)], "id string, version int")
    assert {r.id: r.allowed for r in ledger.check_cap(nodes, done).collect()} == {"a": False, "b": True}
    assert {r.id: r.allowed for r in ledger.check_cap(nodes, None).collect()} == {"a": True, "b": False}


def test_model_steps(spark):
    seen = spark.sparkContext.accumulator(0)

    def client(prompts):
        seen.add(len(prompts))
        return [(json.dumps({"chars": len(p)}), "stop") for p in prompts]

    rows = spark.createDataFrame([("k1", "abc"), ("k2", "de")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", '{"chars": 9}', "stop")], "key string, answer string, finish_reason string")
    out = models.ask(rows, "prompt", client, cache)
    value, error = models.parse(F.col("answer"), F.col("finish_reason"), {"chars": "int"})
    assert {(r.key, r.cached, r.n) for r in out.select("key", "cached", value["chars"].alias("n")).collect()} == {("k1", True, 9), ("k2", False, 2)}
    assert seen.value == 1
    steps = {"providers": {"p": {}}, "defaults": {"model": "m"}, "steps": {"s": {"provider": "p"}}}
    assert models.resolve(steps, "s", env={"S_MODEL": "n"})["model"] == "n"
    with pytest.raises(ValueError, match="no provider"):
        models.resolve(steps, "t")


def test_index_rules(spark):
    wide = spark.createDataFrame([("a", [1.0, 2.0])], "node_id string, embedding array<float>")
    assert index.checked_vectors(wide, 2).count() == 1
    with pytest.raises(Exception, match="vector width"):
        index.checked_vectors(wide, 3).collect()
    none = spark.createDataFrame([], "modified timestamp")
    assert index.is_stale(none, F.lit(None).cast("timestamp")).first().stale is True


def test_node_files(spark, tmp_path):
    pytest.importorskip("yaml")
    from loomwright.sources import nodes as N

    text = "---\nid: haus\ntitle_de: Häuser\ntitle_en: house\ntype: vocab\ncefr: A1\nthemes: []\nstatus: draft\nsource_ids: [s1]\nlinks:\n- {target: x, relation: governs}\n---\n\nBody\n"
    (tmp_path / "haus.md").write_text(text, encoding="utf-8")
    read = N.read_nodes(spark, f"file://{tmp_path}")
    row = read.first()
    assert (row.id, row.themes, row.register, row.body_md, row.links[0].target) == ("haus", [], None, "Body", "x")
    out = tmp_path / "out"
    N.write_nodes(read, f"file://{out}")
    assert N.parse_node("haus", (out / "haus.md").read_text(encoding="utf-8")) == N.parse_node("haus", text)
    for bad in (text.replace("vocab", "thing"), text.replace("id: haus", "id: maus"), text.replace("status: draft\n", ""), text.replace("cefr: A1", "cefr: A1\nmore: 1")):
        with pytest.raises(ValueError):
            N.parse_node("haus", bad)


def test_files(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("# list\nHaus\n\nwaschen\n", encoding="utf-8")
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "x.png").write_bytes(b"")
    assert {(r.lemma, r.level) for r in files.read_wordlists(spark, f"file://{tmp_path}").collect()} == {("Haus", "A1"), ("waschen", "A1")}
    assert files.read_wordlists(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="not UTF-8"):
        files.read_texts(spark, f"file://{tmp_path}/bad.bin").collect()
    assert files.read_images(spark, f"file://{tmp_path}/x.png").count() == 0  # Spark reads no empty file
    rows = spark.createDataFrame([("a.png", 0), ("b.JPG", 5), ("c.txt", 5), ("d.webp", 11 << 20)], "path string, length long")
    assert [(r.media_type, r.error) for r in ingest.check_images(rows).collect()] == [("image/png", "empty"), ("image/jpeg", None), (None, "unsupported type"), ("image/webp", "too large")]


def test_watch_appends_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("eins")
    (source / "b.txt").write_text("eins")
    where = [f"file://{tmp_path}/{x}" for x in ("in", "out", "check")]
    watch.watch(spark, *where).awaitTermination(60)
    (source / "c.txt").write_text("zwei")
    watch.watch(spark, *where).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(where[1]).collect()) == ["eins", "zwei"]
