"""Proposals from end to end, embedding, and what odd states do."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import embed, proposals
from loomwright.schemas import PROPOSAL


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"body {i}") for i in ids], "id string, body_md string")


def test_proposals_are_written_read_and_resolved(spark, tmp_path):
    own = spark.createDataFrame([("create-a-1", "create", "a", 0.2), ("link-b-2", "link", "b", None)], "id string, kind string, candidate string, similarity double")
    full = proposals.read_proposals(spark, str(tmp_path / "none")).unionByName(own, allowMissingColumns=True)
    assert full.columns == [x.split()[0] for x in " ".join(PROPOSAL.split()).split(", ")]
    proposals.write_proposals(full, full.where("kind = 'link'").withColumn("reason", F.lit("again")), str(tmp_path / "p"))
    back = proposals.read_proposals(spark, str(tmp_path / "p"))
    assert [(r.id, r.reason) for r in proposals.listing(back).collect()] == [("create-a-1", None), ("link-b-2", "again")]
    now = F.expr("timestamp'2026-01-02 03:04:05'")
    ledger = proposals.record(back.where("kind = 'link'"), F.lit(False), now)
    row = ledger.first()
    assert (row.decision_id, row.approved, row.changelog, row.flags) == ("20260102T030405-link-b-2", False, "rejected at review", None)
    assert [r.id for r in proposals.resolve(back, ledger).collect()] == ["create-a-1"]


def test_the_staged_row_wins_and_existing_ids_are_refused(spark):
    nodes, staged = rows(spark, "n1", "c1"), rows(spark, "c1", "c2", "c3")
    approved = spark.createDataFrame([("c1",), ("c2",), ("c2",), ("gone",)], "candidate string")
    after, refused, left = proposals.apply_creates(nodes, approved, staged)
    assert sorted(r.id for r in after.collect()) == ["c1", "c2", "n1"] and [r.id for r in refused.collect()] == ["c1"]
    assert sorted(r.id for r in left.collect()) == ["c1", "c3"]
    with pytest.raises(Exception, match="neither a node nor staged: c9"):
        proposals.sides(rows(spark, "c9"), nodes, staged).collect()


def test_capped_merges_wait_for_a_person(spark):
    pairs = spark.createDataFrame([("a", "x", 1, 0.9), ("b", "y", 1, 0.96), ("c", "z", 1, 0.9)], "candidate string, other string, rank int, similarity double")
    assert sorted(r.candidate for r in proposals.needs_call(pairs).collect()) == ["a", "c"]
    said = spark.createDataFrame([("a", "x", "OVERLAP", 0.8)], "candidate string, other string, outcome string, confidence double")
    judged = proposals.adjudicate(pairs, said)
    assert sorted((r.candidate, r.outcome, r.basis) for r in judged.collect()) == [("a", "OVERLAP", "llm"), ("b", "SAME", "threshold")]
    capped = spark.createDataFrame([("x", False), ("y", False)], "id string, allowed boolean")
    got = {r.candidate: (r.kind, r.outcome) for r in proposals.propose(judged, capped).collect()}
    assert got == {"a": ("discard", "MANUAL"), "b": ("merge", "SAME")}
    assert proposals.propose(judged.limit(0), capped).count() == 0


def test_archive_numbers_what_was_archived_before(spark):
    gone = spark.createDataFrame([("a", "w", "t"), ("b", "w", "t")], "id string, winner string, body_md string")
    old = spark.createDataFrame([("a",), ("a",)], "node_id string")
    assert sorted((r.name, r.node_id, r.body_md) for r in proposals.archive(gone, old, F.current_timestamp()).collect()) == [("a-3", "a", "t"), ("b", "b", "t")]


def test_vectors_come_from_the_cache_first(spark):
    nodes = spark.createDataFrame([("n1", "t", "x"), ("n2", "t", "x"), ("n3", "u", "y")], "id string, title_de string, body_md string")
    none = spark.createDataFrame([], "key string, embedding array<float>")
    first = embed.vectors_for(nodes, "m", none, lambda texts: [[1.0, float(len(t))] for t in texts], 2)
    assert sorted((r.node_id, r.computed) for r in first.collect()) == [("n1", True), ("n2", True), ("n3", True)]
    cache = first.where("node_id = 'n1'").select("key", "embedding")
    assert sorted(r.node_id for r in embed.vectors_for(nodes, "m", cache, None, 2).collect()) == ["n1", "n2"]
    assert embed.vectors_for(nodes, "m", cache, None, 3).count() == 0
    with pytest.raises(Exception, match="width"):
        embed.vectors_for(nodes, "m", none, lambda texts: [[1.0] for _ in texts], 2).collect()
    stored = embed.store_vectors(first.where("node_id = 'n3'"), first)
    assert stored.count() == 3 and [r.value for r in embed.get_meta(embed.set_meta(spark.createDataFrame([("a", "1")], "key string, value string"), "a", F.lit(2)), "a").collect()] == ["2"]
