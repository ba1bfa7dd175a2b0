"""Queries of proposals, their application, and of embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import embed, ledger, merge, proposals, review
from loomwright.plans.registry import query, table
from loomwright.schemas import LINK

_OUTCOMES = ("SAME", "OVERLAP", "DISTINCT_RELATED", "DISTINCT", "DISTINCT")
_SQL_OUTCOMES = "['SAME', 'OVERLAP', 'DISTINCT_RELATED', 'DISTINCT', 'DISTINCT']"
_PAIRS = f"""p AS (SELECT 'c' || o_custkey AS candidate, 'n' || (o_orderkey % 500) AS other, o_orderkey AS rank, (o_orderkey % 100) / 100.0::DOUBLE AS similarity,
  {_SQL_OUTCOMES}[1 + (o_orderkey % 5)::INT] AS verdict, (o_orderkey % 500) % 7 <> 0 AS allowed FROM orders),
j AS (SELECT candidate, other, rank, allowed, CASE WHEN similarity >= 0.95 THEN 'SAME' ELSE verdict END AS outcome, CASE WHEN similarity >= 0.95 THEN 'threshold' ELSE 'llm' END AS basis,
  CASE WHEN similarity >= 0.95 THEN similarity ELSE 0.5::DOUBLE END AS confidence FROM p)"""


def _judged(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pairs = o.select(
        F.concat(F.lit("c"), "o_custkey").alias("candidate"), F.concat(F.lit("n"), F.col("o_orderkey") % 500).alias("other"), F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") % 100 / 100.0).alias("similarity")
    )
    asked = proposals.needs_call(pairs)
    verdicts = asked.groupBy("candidate", "other").agg(F.get(F.array(*map(F.lit, _OUTCOMES)), F.min("rank") % 5).alias("outcome"), F.lit(0.5).alias("confidence"))
    return proposals.adjudicate(pairs, verdicts)


@query(f"WITH {_PAIRS}, v AS (SELECT candidate, other, min(rank) AS r FROM p WHERE similarity < 0.95 GROUP BY ALL) SELECT candidate, other, rank, CASE WHEN basis = 'threshold' THEN outcome ELSE {_SQL_OUTCOMES}[1 + (r % 5)::INT] END AS outcome, basis, confidence FROM j LEFT JOIN v USING (candidate, other)")
def adjudicated_pairs(spark, sf_dir):
    return _judged(spark, sf_dir)


_PROPOSED = f"""{_PAIRS}, v AS (SELECT candidate, other, min(rank) AS r FROM p WHERE similarity < 0.95 GROUP BY ALL),
k AS (SELECT candidate, other, rank, allowed, CASE WHEN basis = 'threshold' THEN outcome ELSE {_SQL_OUTCOMES}[1 + (r % 5)::INT] END AS outcome FROM j LEFT JOIN v USING (candidate, other)),
f AS (SELECT *, min(CASE WHEN outcome IN ('SAME', 'OVERLAP') THEN rank END) OVER (PARTITION BY candidate) AS fate FROM k),
q AS (SELECT candidate, other, outcome, allowed, 'merge' AS kind FROM f WHERE rank = fate UNION ALL SELECT candidate, other, outcome, allowed, 'link' FROM f WHERE fate IS NULL AND outcome = 'DISTINCT_RELATED'
  UNION ALL SELECT DISTINCT candidate, NULL, 'DISTINCT', true, 'create' FROM f WHERE fate IS NULL),
capped AS (SELECT candidate, other, kind = 'merge' AND outcome = 'OVERLAP' AND NOT allowed AS refused, kind AS k0, outcome AS o0 FROM q),
proposed AS (SELECT candidate, other AS counterpart, CASE WHEN refused THEN 'discard' ELSE k0 END AS kind, CASE WHEN refused THEN 'MANUAL' ELSE o0 END AS outcome FROM capped),
named AS (SELECT kind || '-' || candidate || '-' || substr(sha256(kind || '|' || candidate || '|' || coalesce(counterpart, '') || '|'), 1, 8) AS id, * FROM proposed)"""


def _proposed(spark, sf_dir):
    allowed = spark.range(500).select(F.concat(F.lit("n"), "id").alias("id"), (F.col("id") % 7 != 0).alias("allowed"))
    return proposals.propose(_judged(spark, sf_dir), allowed)


@query(f"WITH {_PROPOSED} SELECT id, kind, outcome, candidate, coalesce(counterpart, '') AS counterpart FROM named")
def proposed_changes(spark, sf_dir):
    return _proposed(spark, sf_dir).withColumn("counterpart", F.coalesce("counterpart", F.lit("")))


@query(f"WITH {_PROPOSED} SELECT kind, count(*) AS proposals, sum((kind IN ('merge', 'create'))::INT)::BIGINT AS writing FROM named GROUP BY kind")
def proposals_by_kind(spark, sf_dir):
    return proposals.by_kind(_proposed(spark, sf_dir))


_NOW = "timestamp'2026-01-02 03:04:05'"


@query(f"WITH {_PROPOSED} SELECT '20260102T030405-' || id AS decision_id, id AS proposal_id, kind <> 'discard' AS approved, kind, outcome, CASE WHEN kind = 'discard' THEN 'rejected at review' ELSE '' END AS changelog FROM named")
def recorded_decisions(spark, sf_dir):
    rows = proposals.record(_proposed(spark, sf_dir), F.col("kind") != "discard", F.expr(_NOW))
    return rows.select("decision_id", "proposal_id", "approved", "kind", "outcome", F.coalesce("changelog", F.lit("")).alias("changelog"))


@query(f"WITH {_PROPOSED} SELECT id, kind FROM named WHERE kind NOT IN ('link', 'discard')")
def pending_after_decisions(spark, sf_dir):
    pending = _proposed(spark, sf_dir)
    decided = proposals.record(pending.where("kind in ('link', 'discard')"), F.col("kind") == "link", F.expr(_NOW))
    return proposals.resolve(pending, decided).select("id", "kind")


def _staged(spark, sf_dir):
    """Accepted nodes are parts, staged ones documents."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body_md"))
    return nodes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body_md"))


@query("SELECT p_partkey AS id, 'node' AS state FROM part UNION ALL SELECT doc_id, CASE WHEN doc_id IN (SELECT p_partkey FROM part) THEN 'refused' WHEN lang = 'en' THEN 'node' END FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'staged' FROM documents WHERE lang <> 'en' OR doc_id IN (SELECT p_partkey FROM part)")
def create_apply(spark, sf_dir):
    nodes, staged = _staged(spark, sf_dir)
    approved = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("candidate"))
    parts = zip(proposals.apply_creates(nodes, approved, staged), ("node", "refused", "staged"), strict=True)
    out = [df.select("id", F.lit(name).alias("state")) for df, name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT doc_id AS id, coalesce(p_name, text) AS body_md FROM documents LEFT JOIN part ON p_partkey = doc_id")
def proposal_sides(spark, sf_dir):
    nodes, staged = _staged(spark, sf_dir)
    return proposals.sides(staged.select("id"), nodes, staged)


@query("SELECT name, node_id, merged_into FROM (SELECT doc_id AS node_id, doc_id + 1 AS merged_into, CASE WHEN n IS NULL THEN doc_id::VARCHAR ELSE doc_id || '-' || (n + 1) END AS name FROM documents LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = doc_id)")
def archived_nodes(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("winner"))
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"))
    rows = proposals.archive(gone, old, F.expr(_NOW))
    return rows.select(F.col("name").cast("string").alias("name"), "node_id", "merged_into")


@query("SELECT doc_id, sha256(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')) AS digest FROM documents")
def dedup_texts(spark, sf_dir):
    text = embed.dedup_text(F.col("source"), F.col("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query("SELECT doc_id AS node_id, length(text) * 1.0::DOUBLE AS first, source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0') AS computed FROM documents")
def embedded_nodes(spark, sf_dir):
    def lengths(texts):
        return [[float(len(t)), 1.0] for t in texts]

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title_de"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("body_md"), "source", "text")
    # a plain text is its own prose only without marks, so the key stands for the text
    key = embed.vector_key("m", embed.T.embed_text(F.col("title_de"), F.col("body_md")))
    cache = d.where("source = 'src0'").select(key.alias("key"), F.array(F.lit(-1.0), F.lit(1.0)).cast("array<float>").alias("embedding"), F.length("text").alias("n"))
    got = embed.vectors_for(d, "m", cache, lengths, 2)
    return got.join(d.select(F.col("id").alias("node_id"), F.length("text").alias("n")), "node_id").select("node_id", (F.col("n") * 1.0).alias("first"), "computed")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def indexed_nodes(spark, sf_dir):
    return embed.indexed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id")))


@query("SELECT lang AS name, '3' AS value FROM documents WHERE lang = 'en' GROUP BY 1 UNION ALL SELECT lang, count(*)::VARCHAR FROM documents WHERE lang <> 'en' GROUP BY 1")
def meta_values(spark, sf_dir):
    meta = table(spark, sf_dir, "documents").where("lang is not null").groupBy(F.col("lang").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return embed.set_meta(meta, "en", F.lit(3)).withColumnRenamed("key", "name")


@query("SELECT user_id, max(ts) >= TIMESTAMP '2024-01-15' AS kept FROM events GROUP BY user_id")
def cache_clearing(spark, sf_dir):
    entries = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("modified"))
    left = embed.cache_clear(entries, F.expr("timestamp'2024-01-15 00:00:00'")).select("user_id", F.lit(True).alias("kept"))
    return entries.select("user_id").join(left, "user_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


_REVIEW = r"""docs AS (SELECT doc_id::VARCHAR AS id, doc_id AS k, text FROM documents),
nodes AS (SELECT * FROM docs WHERE k % 2 = 0), staged AS (SELECT * FROM docs WHERE k % 2 = 1),
created AS (SELECT * FROM staged WHERE k % 6 = 1 AND k % 5 <> 0),
live AS (SELECT * FROM nodes UNION ALL SELECT * FROM created),
merged AS (SELECT s.id AS loser, s.k AS lk, s.text AS ltext, w.id AS winner FROM staged s JOIN nodes w ON w.k = s.k - s.k % 10 WHERE s.k % 6 = 3),
last AS (SELECT winner, count(*) AS times, max_by(ltext, loser) AS body, list('s' || lk ORDER BY loser) AS more FROM merged GROUP BY winner),
edges AS (SELECT a.id, count(*) AS links FROM live a JOIN live b ON b.k = a.k + 1 GROUP BY a.id),
asked AS (SELECT (o_custkey % n.total)::BIGINT AS k, o_orderkey, ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][1 + (o_orderkey % 6)::INT] AS cefr FROM orders, (SELECT count(*) AS total FROM documents) n),
levels AS (SELECT k, count(*) AS times, max_by(cefr, 'relevel-' || o_orderkey) AS cefr FROM asked GROUP BY k)"""


@query(f"""WITH {_REVIEW} SELECT l.id, (1 + coalesce(m.times, 0) + coalesce(v.times, 0))::INT AS version, coalesce(v.cefr, 'A1') AS cefr, coalesce(e.links, 0)::INT AS links,
  array_to_string(['s' || l.k] || coalesce(m.more, []), ',') AS sources, sha256(coalesce(m.body, l.text)) AS body_sha256
FROM live l LEFT JOIN last m ON m.winner = l.id LEFT JOIN edges e ON e.id = l.id LEFT JOIN levels v ON v.k = l.k""")
def review_fold(spark, sf_dir):
    """Creations, merges, links and levels, several to a node, in one review, and the same review again."""
    nodes, staged, pending, said, _ = _review_case(spark, sf_dir)
    none = spark.createDataFrame([], "node_id string")
    first = review.review(nodes, staged, pending, said, None, none, F.expr(_NOW))
    # the decisions that were recorded, taken again over all that was pending: nothing more happens
    done = first.ledger.select("proposal_id")
    again = review.review(first.nodes, first.staged, pending, said.join(done, "proposal_id", "left_semi"), first.ledger, first.archived.select("node_id"), F.expr(_NOW))
    return again.nodes.select("id", "version", "cefr", F.coalesce(F.size("links"), F.lit(0)).alias("links"), F.array_join("source_ids", ",").alias("sources"), F.sha2("body_md", 256).alias("body_sha256"))


@query(f"""WITH {_REVIEW} SELECT kind, state, count(*) AS proposals FROM (
  SELECT 'create' AS kind, CASE WHEN k % 5 = 0 THEN 'rejected' ELSE 'applied' END AS state FROM staged WHERE k % 6 = 1
  UNION ALL SELECT 'merge', 'applied' FROM merged
  UNION ALL SELECT 'link', CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'refused' ELSE 'applied' END FROM docs d LEFT JOIN live a ON a.k = d.k LEFT JOIN live b ON b.k = d.k + 1
  UNION ALL SELECT 'relevel', CASE WHEN k IN (SELECT k FROM live) THEN 'applied' ELSE 'refused' END FROM asked) x GROUP BY ALL""")
def review_results(spark, sf_dir):
    nodes, staged, pending, said, _ = _review_case(spark, sf_dir)
    out = review.review(nodes, staged, pending, said, None, spark.createDataFrame([], "node_id string"), F.expr(_NOW))
    return out.results.groupBy("kind", "state").agg(F.count("*").alias("proposals"))


def _review_case(spark, sf_dir):
    """Even documents are nodes, odd ones staged; proposals of four kinds over them, levels from ``orders``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    row = docs.select(
        F.col("k").cast("string").alias("id"), F.lit("A1").alias("cefr"), F.lit(None).cast("string").alias("cefr_basis"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("array<string>").alias("lemmas"),
        F.lit(None).cast("boolean").alias("separable"), F.lit(None).cast("string").alias("family_transparency"), F.lit(None).cast(f"array<{LINK}>").alias("links"), F.array(F.concat(F.lit("s"), "k")).alias("source_ids"),
        F.lit("stable").alias("status"), F.lit(1).alias("version"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("text").alias("body_md"), "k",
    )
    nodes, staged = row.where("k % 2 = 0").drop("k"), row.where("k % 2 = 1").drop("k")
    name = F.col("k").cast("string")

    def proposal(df, kind, id_, **values):
        given = {"id": F.concat(F.lit(f"{kind}-"), id_), "kind": F.lit(kind), "similarity": F.lit(0.5), **values}
        return df.select(*(given.get(f, F.lit(None)).cast(t).alias(f) for f, t in review.PROPOSAL_FIELDS))

    pending = proposal(docs.where("k % 6 = 1"), "create", name, candidate=name)
    merges = docs.where("k % 6 = 3")
    pending = pending.unionByName(proposal(merges, "merge", name, candidate=name, winner=(F.col("k") - F.col("k") % 10).cast("string"), loser=name, outcome=F.lit("SAME"), body_md=F.col("text")))
    pending = pending.unionByName(proposal(docs, "link", name, candidate=(F.col("k") + 1).cast("string"), counterpart=name, relation=F.lit("next"), direction=F.lit("a_to_b")))
    total = docs.agg(F.count("*").alias("total"))
    asked = table(spark, sf_dir, "orders").crossJoin(F.broadcast(total))  # one row
    level = F.get(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "C1", "C2"))), F.col("o_orderkey") % 6)
    pending = pending.unionByName(proposal(asked, "relevel", F.col("o_orderkey").cast("string"), candidate=(F.col("o_custkey") % F.col("total")).cast("string"), cefr=level, cefr_basis=F.lit("list")))
    approved = ~((F.col("kind") == "create") & (F.col("candidate").cast("long") % 5 == 0))
    said = pending.select(F.col("id").alias("proposal_id"), approved.alias("approved"), F.expr(_NOW).alias("decided_at"), F.lit(None).cast("string").alias("note"))
    return nodes, staged, pending, said, docs


_COMPLETE = f"""{_PAIRS}, v AS (SELECT candidate, other, min(rank) AS r FROM p WHERE similarity < 0.95 GROUP BY ALL),
k AS (SELECT candidate, other, rank, basis, confidence, CASE WHEN basis = 'threshold' THEN outcome ELSE {_SQL_OUTCOMES}[1 + (r % 5)::INT] END AS outcome FROM j LEFT JOIN v USING (candidate, other)),
one AS (SELECT candidate, other, min(rank) AS rank, arg_min(outcome, rank) AS outcome, arg_min(confidence, rank) AS confidence FROM k GROUP BY ALL),
f AS (SELECT *, min(CASE WHEN outcome IN ('SAME', 'OVERLAP') THEN rank END) OVER (PARTITION BY candidate) AS fate FROM one),
q AS (SELECT candidate, other, outcome, confidence, 'merge' AS kind FROM f WHERE rank = fate UNION ALL SELECT candidate, other, outcome, confidence, 'link' FROM f WHERE fate IS NULL AND outcome = 'DISTINCT_RELATED'
  UNION ALL SELECT DISTINCT candidate, NULL, 'DISTINCT', NULL, 'create' FROM f WHERE fate IS NULL),
won AS (SELECT *, substr(candidate, 2)::BIGINT % 2 = 0 OR substr(other, 2)::BIGINT % 3 > substr(candidate, 2)::BIGINT % 3 OR (substr(other, 2)::BIGINT % 3 = substr(candidate, 2)::BIGINT % 3 AND other <= candidate) AS other_wins FROM q),
paired AS (SELECT *, CASE WHEN kind = 'merge' THEN CASE WHEN other_wins THEN other ELSE candidate END END AS winner, CASE WHEN kind = 'merge' THEN CASE WHEN other_wins THEN candidate ELSE other END END AS loser FROM won),
capped AS (SELECT *, kind = 'merge' AND outcome = 'OVERLAP' AND other_wins AND substr(other, 2)::BIGINT % 7 = 0 AS refused FROM paired),
whole AS (SELECT candidate, other, winner, loser, refused, confidence, CASE WHEN refused THEN 'discard' ELSE kind END AS kind, CASE WHEN refused THEN 'MANUAL' ELSE outcome END AS outcome FROM capped)"""


def _complete(spark, sf_dir):
    judged = _judged(spark, sf_dir).dropDuplicates(["candidate", "other", "rank"])
    none = {c: F.lit(None).cast("string") for c in ("tier", "band", "reason", "b_adds", "provider", "model")}
    judged = judged.withColumns(none | {"similarity": F.lit(0.9), "relation": F.lit(None).cast("string"), "direction": F.lit("a_to_b")})
    # one verdict a pair: the first
    judged = judged.groupBy("candidate", "other").agg(F.min_by(F.struct("rank", "outcome", "basis", "confidence", "similarity", "relation", "direction", *none), "rank").alias("v")).select("candidate", "other", "v.*")
    number = lambda c: F.substring(c, 2, 20).cast("long")
    sources = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), number(c) % 3), lambda x: F.concat(F.lit("s"), x))
    body = lambda c: F.concat(F.lit("## Examples\n- "), c)
    candidates = judged.select(F.col("candidate").alias("id")).distinct().select("id", F.lit("src").alias("source_id"), F.when(number(F.col("id")) % 2 == 0, "queue").alias("path"), sources(F.col("id")).alias("source_ids"), body(F.col("id")).alias("body_md"))
    nodes = judged.select(F.col("other").alias("id")).distinct().select("id", sources(F.col("id")).alias("source_ids"), body(F.col("id")).alias("body_md"))
    caps = nodes.select("id", (number(F.col("id")) % 7 != 0).alias("allowed"), F.lit(5).cast("long").alias("n_merges"))
    new = judged.where("outcome = 'OVERLAP'").select("candidate", "other", F.lit("new").alias("body_md"), F.lit("log").alias("changelog"), F.lit(False).alias("unsourced"))
    return judged, review.complete(judged, candidates, nodes, caps, new, F.expr(_NOW))


@query(f"""WITH {_COMPLETE} SELECT kind || '-' || candidate || '-' || substr(sha256(kind || '|' || candidate || '|' || coalesce(other, '') || '|'), 1, 8) AS id, kind, outcome, coalesce(winner, '') AS winner, coalesce(loser, '') AS loser,
  array_to_string(list_filter([CASE WHEN refused THEN 'cap-reached' END, CASE WHEN confidence < 0.6 THEN 'low-confidence' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN kind = 'merge' THEN CASE WHEN outcome = 'SAME' THEN '## Examples' || chr(10) || '- ' || winner || chr(10) || '- ' || loser || chr(10) ELSE 'new' END ELSE '' END AS body_md FROM whole""")
def complete_proposals(spark, sf_dir):
    """Every column of the proposals of judged pairs: sides, flags and bodies."""
    out = _complete(spark, sf_dir)[1]
    body = F.when(F.col("kind") == "merge", F.col("body_md")).otherwise(F.lit(""))
    return out.select("id", "kind", "outcome", *(F.coalesce(c, F.lit("")).alias(c) for c in ("winner", "loser")), F.array_join("flags", ",").alias("flags"), body.alias("body_md"))


@query(f"WITH {_COMPLETE} SELECT least(candidate, other) AS left_id, greatest(candidate, other) AS right_id FROM one EXCEPT SELECT least(winner, loser), greatest(winner, loser) FROM whole WHERE winner IS NOT NULL")
def undecided_after_review(spark, sf_dir):
    """Pairs that are still open once all proposals were rejected: those of merges are not asked again."""
    judged, proposed = _complete(spark, sf_dir)
    log = proposals.record(proposed, F.lit(False), F.expr(_NOW))
    pairs = judged.select(F.least("candidate", "other").alias("left_id"), F.greatest("candidate", "other").alias("right_id")).distinct()
    return merge.undecided(pairs, ledger.decided_pairs(log))
