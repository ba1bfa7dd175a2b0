"""Queries of the index, the ledgers, ingest and the application of proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import index, ingest, ledger, merge, models
from loomwright.plans.registry import query, table

_LEVEL = "['A1','A2','B1','B2','C1','C2'][1 + (doc_id % 6)::INT]"
_TYPE = "['grammar','vocab','phrase','pattern','culture'][1 + (doc_id % 5)::INT]"


def _nodes(spark, sf_dir):
    """Documents as nodes: levels and types by id, the source as theme, the next ids as links."""
    d = table(spark, sf_dir, "documents")
    level = F.get(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "C1", "C2"))), F.col("doc_id") % 6)
    kind = F.get(F.array(*map(F.lit, ("grammar", "vocab", "phrase", "pattern", "culture"))), F.col("doc_id") % 5)
    link = lambda step, name: F.struct((F.col("doc_id") + step).cast("string").alias("target"), F.lit(name).alias("relation"), F.lit(0.5).alias("confidence"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        level.alias("cefr"),
        kind.alias("type"),
        F.array("source", "lang").alias("themes"),
        F.array(link(1, "governs"), link(7, "same_family")).alias("links"),
        F.array("source").alias("source_ids"),
        F.lit("stable").alias("status"),
        F.lit(1).alias("version"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        F.col("text").alias("body_md"),
        F.col("doc_id").alias("seq"),
    )


@query(f"SELECT doc_id::VARCHAR AS id, {_LEVEL} AS cefr, {_TYPE} AS type FROM documents WHERE {_LEVEL} = 'B1' AND {_TYPE} = 'vocab'")
def node_listing(spark, sf_dir):
    return index.list_nodes(_nodes(spark, sf_dir), level="B1", type_="vocab").select("id", "cefr", "type")


@query(f"SELECT doc_id::VARCHAR AS id, {_LEVEL} AS cefr FROM documents WHERE source = 'src3' AND {_LEVEL} = 'A2'")
def node_filter_by_tag(spark, sf_dir):
    nodes, _, themes = index.reindex(_nodes(spark, sf_dir))
    return index.list_nodes(nodes, themes, level="A2", theme="src3").select("id", "cefr")


@query("SELECT unnest(['nodes', 'links', 'themes']) AS what, unnest([count(*), 2 * count(*), count(source) + count(lang)]) AS n FROM documents")
def index_counts(spark, sf_dir):
    return index.index_counts(*index.reindex(_nodes(spark, sf_dir)))


@query("SELECT doc_id::VARCHAR AS source_id, unnest([(doc_id + 1)::VARCHAR, (doc_id + 7)::VARCHAR]) AS target, unnest(['governs', 'same_family']) AS relation FROM documents")
def index_links(spark, sf_dir):
    return index.reindex(_nodes(spark, sf_dir))[1].select("source_id", "target", "relation")


@query("SELECT max(ts) > TIMESTAMP '2024-01-15' AS stale FROM events")
def staleness(spark, sf_dir):
    return index.is_stale(table(spark, sf_dir, "events").select(F.col("ts").alias("modified")), F.lit("2024-01-15").cast("timestamp"))


@query("SELECT doc_id, CASE lower(trim(source)) WHEN 'src1' THEN 'news' WHEN 'src2' THEN 'news' ELSE lower(trim(source)) END AS tag FROM documents")
def tag_aliases(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), F.upper("source"), F.lit(" ")).alias("tag"))
    return index.normalize_tags(tags, spark.createDataFrame([("SRC1", "news"), ("src2 ", "news")], "alias string, canonical string"))


@query("SELECT vec_id AS node_id, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS generation FROM embeddings")
def vector_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    old = index.checked_vectors(rows.withColumn("node_id", F.col("node_id")), 64).withColumn("generation", F.lit(0))
    new = old.where("node_id % 10 = 0").withColumn("generation", F.lit(1))
    return index.upsert(old, new, "node_id").select("node_id", "generation")


@query("SELECT doc_id, text IN (SELECT text FROM documents WHERE source = 'src0' AND n_chars >= 20) AS hit FROM documents WHERE source <> 'src0'")
def cache_hit_miss(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    cache = d.where("source = 'src0'").select("key", F.col("n_chars").alias("value"))
    return index.cache_split(d.where("source <> 'src0'").select("doc_id", "key"), cache, "key", "value", F.col("value") >= 20).select("doc_id", "hit")


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY text")
def write_once_append(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return index.write_once(d.where("source = 'src0'").select("digest"), d.where("source <> 'src0'").select("digest", "doc_id"), "digest")


@query("SELECT count(*) AS entries, sum(n_chars)::BIGINT AS bytes FROM documents")
def cache_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("bytes"), F.lit(0).alias("modified"))
    return index.cache_stats(d).select("entries", "bytes")


@query("SELECT source AS source_id, count(*) AS pending, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY source")
def queue_listing(spark, sf_dir):
    return index.queue_listing(table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("id")))


@query("SELECT source AS source_id, doc_id AS id, count(*) OVER (PARTITION BY source) AS pending FROM documents")
def queue_rows(spark, sf_dir):
    return index.queue_rows(table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("id")))


_USAGE = """usage AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS step, 'm' || (user_id % 3) AS model, 'p' || (user_id % 2) AS provider, event_type = 'view' AS cached,
  (props->>'$.k')::BIGINT * 10 AS prompt_tokens, (props->>'$.k')::BIGINT AS cached_prompt_tokens, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS completion_tokens,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS cost_usd, CASE WHEN event_type = 'view' THEN value END AS saved_usd FROM events)"""
_SUMS = """count(*) AS calls, sum(cached::INT)::BIGINT AS hits, round(sum(cached::INT) / count(*), 9) AS hit_rate, sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens,
  sum(coalesce(cached_prompt_tokens, 0))::BIGINT AS cached_prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))::BIGINT AS total_tokens,
  round(coalesce(sum(cost_usd), 0), 4) AS cost_usd, round(sum(coalesce(saved_usd, 0)), 4) AS saved_usd, sum((cost_usd IS NULL)::INT)::BIGINT AS unpriced_calls"""


def _usage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    completion = F.when(F.col("user_id") % 7 != 0, F.col("user_id"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.col("event_type").alias("step"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.concat(F.lit("p"), F.col("user_id") % 2).alias("provider"),
        (F.col("event_type") == "view").alias("cached"),
        (F.col("k") * 10).alias("prompt_tokens"),
        F.col("k").alias("cached_prompt_tokens"),
        completion.alias("completion_tokens"),
        (F.col("k") * 10 + F.coalesce(completion, F.lit(0))).alias("total_tokens"),
        F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("cost_usd"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("saved_usd"),
    )


def _rounded(df):
    return df.withColumns({"hit_rate": F.round("hit_rate", 9), "cost_usd": F.round("cost_usd", 4), "saved_usd": F.round("saved_usd", 4)})


@query(f"WITH {_USAGE} SELECT {_SUMS} FROM usage")
def usage_totals(spark, sf_dir):
    return _rounded(ledger.usage_totals(_usage(spark, sf_dir)))


@query(f"WITH {_USAGE} SELECT step AS name, {_SUMS} FROM usage GROUP BY 1")
def usage_by_step(spark, sf_dir):
    return _rounded(ledger.usage_totals(_usage(spark, sf_dir), "step"))


@query(f"WITH {_USAGE} SELECT model AS name, {_SUMS} FROM usage GROUP BY 1")
def usage_by_model(spark, sf_dir):
    return _rounded(ledger.usage_totals(_usage(spark, sf_dir), "model"))


@query(f"WITH {_USAGE} SELECT provider AS name, {_SUMS} FROM usage GROUP BY 1")
def usage_by_provider(spark, sf_dir):
    return _rounded(ledger.usage_totals(_usage(spark, sf_dir), "provider"))


@query(f"WITH {_USAGE} SELECT ts[1:10] AS name, {_SUMS} FROM usage GROUP BY 1")
def usage_by_day(spark, sf_dir):
    return _rounded(ledger.usage_totals(_usage(spark, sf_dir), "day"))


@query(f"WITH {_USAGE} SELECT {_SUMS} FROM usage WHERE ts[1:10] >= '2024-01-20'")
def usage_since(spark, sf_dir):
    return _rounded(ledger.usage_totals(ledger.since(_usage(spark, sf_dir), "2024-01-20")))


@query(f"WITH {_USAGE} SELECT step AS name, grouping(step) = 1 AS is_total, {_SUMS} FROM usage GROUP BY GROUPING SETS ((step), ())")
def usage_grouping_sets(spark, sf_dir):
    return _rounded(ledger.usage_report(_usage(spark, sf_dir), "step"))


@query(f"WITH {_USAGE} SELECT ts, step, prompt_tokens, round((greatest(prompt_tokens - cached_prompt_tokens, 0) * 0.6::DOUBLE + cached_prompt_tokens * 0.11::DOUBLE + completion_tokens * 2.2::DOUBLE) / 1000000, 9) AS cost FROM usage")
def call_costs(spark, sf_dir):
    rates = [F.lit(x) for x in (0.6, 0.11, 2.2)]
    price = ledger.cost(F.col("prompt_tokens"), F.col("cached_prompt_tokens"), F.col("completion_tokens"), *rates)
    return _usage(spark, sf_dir).select("ts", "step", "prompt_tokens", F.round(price, 9).alias("cost"))


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 200).cast("string").alias("winner"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 200).cast("string")).alias("loser"),
        (F.col("o_orderstatus") == "F").alias("approved"),
        F.when(F.col("o_orderkey") % 9 == 0, "OVERLAP").otherwise("SAME").alias("outcome"),
    )


_DECISIONS = "decisions AS (SELECT (o_custkey % 200)::VARCHAR AS winner, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 200)::VARCHAR END AS loser, o_orderstatus = 'F' AS approved, CASE WHEN o_orderkey % 9 = 0 THEN 'OVERLAP' ELSE 'SAME' END AS outcome FROM orders)"


@query(f"WITH {_DECISIONS} SELECT winner, count(*) AS n_merges FROM decisions WHERE approved AND outcome = 'OVERLAP' GROUP BY winner")
def decision_counts(spark, sf_dir):
    return ledger.merge_counts(_decisions(spark, sf_dir))


@query(f"WITH {_DECISIONS}, n AS (SELECT winner AS id, count(*) AS n_merges FROM decisions WHERE approved AND outcome = 'OVERLAP' GROUP BY winner) SELECT doc_id::VARCHAR AS id, coalesce(n_merges, 0) AS n_merges, coalesce(n_merges, 0) < 5 AS allowed FROM documents LEFT JOIN n ON id = doc_id::VARCHAR")
def cap_check(spark, sf_dir):
    return ledger.check_cap(_nodes(spark, sf_dir), _decisions(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS id, doc_id % 2 = 0 AS allowed FROM documents")
def cap_check_without_ledger(spark, sf_dir):
    return ledger.check_cap(_nodes(spark, sf_dir).withColumn("version", F.when(F.col("seq") % 4 != 0, 1 + F.col("seq").cast("int") % 2)), None).select("id", "allowed")


@query(f"WITH {_DECISIONS} SELECT DISTINCT least(winner, loser) AS left_id, greatest(winner, loser) AS right_id FROM decisions WHERE loser IS NOT NULL")
def decided_pairs(spark, sf_dir):
    return ledger.decided_pairs(_decisions(spark, sf_dir))


@query(f"WITH {_DECISIONS}, done AS (SELECT DISTINCT least(winner, loser) AS l, greatest(winner, loser) AS r FROM decisions WHERE loser IS NOT NULL) SELECT doc_id::VARCHAR AS left_id, (doc_id % 20 + 3)::VARCHAR AS right_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM done WHERE l = doc_id::VARCHAR AND r = (doc_id % 20 + 3)::VARCHAR)")
def undecided_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("left_id"), (F.col("doc_id") % 20 + 3).cast("string").alias("right_id"))
    return merge.undecided(pairs, ledger.decided_pairs(_decisions(spark, sf_dir)))


@query("""SELECT o_orderkey AS id, kind, row_number() OVER (ORDER BY rank, coalesce(similarity, 0) DESC, o_orderkey) AS place FROM (
  SELECT o_orderkey, k AS rank, ['create','merge','link','relevel','morphology','discard'][1 + k] AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 100) / 100.0::DOUBLE END AS similarity FROM (SELECT *, (o_orderkey % 6)::INT AS k FROM orders))""")
def review_order(spark, sf_dir):
    from pyspark.sql import Window

    kinds = F.array(*map(F.lit, ledger.KIND_ORDER))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.get(kinds, F.col("o_orderkey") % 6).alias("kind"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 100 / 100.0).alias("similarity"))
    # places are numbered within each kind, then offset by the kinds before: no task orders all rows
    inside = Window.partitionBy("kind").orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "id")
    numbered = ledger.review_order(rows).withColumn("n", F.row_number().over(inside))
    sizes = rows.groupBy("kind").agg(F.count("*").alias("size"))
    before = Window.orderBy(ledger.kind_rank(F.col("kind"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select("kind", "offset")
    return numbered.join(F.broadcast(offsets), "kind").select("id", "kind", (F.col("n") + F.col("offset")).alias("place"))


@query(r"SELECT p.page_id, count(*) AS pages, sum(ok::INT)::BIGINT AS text_pages, sum(ok::INT) / count(*) AS ratio, sum(ok::INT) / count(*) >= 0.5 AS has_text_layer, coalesce(string_agg(CASE WHEN NOT ok THEN page END, ',' ORDER BY page), '') AS empty_pages FROM (SELECT page_id, page, length(trim(t)) >= 40 AS ok FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS t, generate_subscripts(string_split(html, '<p>'), 1) AS page FROM pages)) p GROUP BY p.page_id")
def page_split(spark, sf_dir):
    from loomwright.sources.files import split_pages

    pages = split_pages(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), "<p>")
    return ingest.page_summary(pages).withColumnRenamed("doc_id", "page_id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 8")
def candidate_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), F.col("source").alias("source_id"))
    return ingest.cap_candidates(rows).select("doc_id", F.col("source_id").alias("source"))


@query("SELECT url AS name, sha256(html) AS digest, '20260101-' || regexp_replace(regexp_replace(trim(substr(trim(regexp_replace(lower(regexp_replace(url, '\\.[^./]*$', '')), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 1, 40), '-'), '^$', 'quelle'), '^-+', '') || '-' || substr(sha256(html), 1, 8) AS source_id, true AS is_new FROM pages".replace("\\\\", "\\"))
def source_ids(spark, sf_dir):
    return ingest.source_ids(table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.col("html").alias("content")), "20260101")


@query(r"""WITH c AS (SELECT doc_id AS seq, regexp_extract(text, '\p{L}+') AS title_de FROM documents), b AS (SELECT *, CASE WHEN title_de = '' THEN 'konzept' ELSE lower(title_de) END AS base FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) + CASE WHEN base IN ('the', 'and') THEN 1 ELSE 0 END AS k FROM b)
SELECT seq, title_de, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS node_id FROM n""")
def id_decollision(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.regexp_extract("text", r"\p{L}+", 0).alias("title_de"))
    return ingest.node_ids(rows, spark.createDataFrame([("the",), ("and",)], "id string"))


@query("SELECT doc_id::VARCHAR AS id, doc_id IN (SELECT p_partkey FROM part) AS refused FROM documents")
def promotion(spark, sf_dir):
    taken = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    accepted, refused = ingest.promote(_nodes(spark, sf_dir), taken)
    return accepted.select("id", F.lit(False).alias("refused")).unionByName(refused.select("id", F.lit(True).alias("refused")))


@query("SELECT DISTINCT lower(tag) AS tag FROM (SELECT unnest([source, lang]) AS tag FROM documents) WHERE lower(tag) NOT IN (SELECT lower(lang) FROM documents)")
def learned_tags(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.lower("lang").alias("tag")).distinct()
    return ingest.learned_tags(_nodes(spark, sf_dir), known)


@query("SELECT doc_id AS id FROM documents UNION SELECT p_partkey FROM part")
def taken_ids(spark, sf_dir):
    return ingest.taken_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query("SELECT a.conv_id, array_to_string(list_distinct_ordered, ',') AS sources FROM (SELECT conv_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT conv_id, list(role ORDER BY turn) || list(role ORDER BY turn DESC) AS l FROM conversations GROUP BY conv_id)) a")
def provenance_union(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return turns.select("conv_id", F.array_join(merge.union_sources(F.col("roles"), F.reverse("roles")), ",").alias("sources"))


@query("SELECT conv_id, array_to_string(list_transform(list(struct_pack(role := role, text := text) ORDER BY turn, role, text), lambda m: m.role || ':' || m.text), chr(30)) AS messages, count(*) AS n FROM conversations GROUP BY conv_id")
def prompt_messages(spark, sf_dir):
    rows = models.conversation_messages(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x1e").alias("messages"), F.size("messages").cast("long").alias("n"))


@query("SELECT l_orderkey AS candidate, l_linenumber::INT AS other, outcome, CASE WHEN outcome IN ('SAME', 'OVERLAP') THEN 'merge' ELSE 'link' END AS kind FROM (SELECT *, min(CASE WHEN outcome IN ('SAME', 'OVERLAP') THEN rank END) OVER (PARTITION BY l_orderkey) AS fate FROM v) WHERE (outcome IN ('SAME', 'OVERLAP') AND rank = fate) OR (fate IS NULL AND outcome = 'DISTINCT_RELATED') UNION ALL SELECT l_orderkey, -1, 'DISTINCT', 'create' FROM v GROUP BY l_orderkey HAVING count(*) FILTER (outcome IN ('SAME', 'OVERLAP')) = 0".replace("FROM v", "FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank, ['SAME', 'OVERLAP', 'DISTINCT_RELATED', 'DISTINCT', 'DISTINCT', 'DISTINCT_RELATED', 'DISTINCT'][1 + (l_partkey % 7)::INT] AS outcome FROM lineitem) v"))
def verdict_fates(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    outcome = F.get(F.array(*map(F.lit, ("SAME", "OVERLAP", "DISTINCT_RELATED", "DISTINCT", "DISTINCT", "DISTINCT_RELATED", "DISTINCT"))), F.col("l_partkey") % 7)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("other"), F.row_number().over(order).alias("rank"), outcome.alias("outcome"))
    return merge.fates(rows).withColumn("other", F.coalesce("other", F.lit(-1)))


@query("SELECT o_orderkey AS id, CASE WHEN staged THEN a WHEN sa <> sb THEN CASE WHEN sa > sb THEN a ELSE b END ELSE least(a, b) END AS winner, CASE WHEN staged THEN b WHEN sa <> sb THEN CASE WHEN sa > sb THEN b ELSE a END ELSE greatest(a, b) END AS loser FROM (SELECT o_orderkey, o_orderkey AS a, o_custkey AS b, o_orderkey % 3 AS sa, o_custkey % 3 AS sb, o_orderstatus = 'O' AS staged FROM orders)")
def winners(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderkey") % 3).alias("a_sources"), (F.col("o_custkey") % 3).alias("b_sources"), (F.col("o_orderstatus") == "O").alias("b_staged"))
    return merge.pick_winner(rows).select("id", "winner", "loser")


_MERGES = "m AS (SELECT doc_id AS loser, (doc_id - doc_id % 10) AS winner, CASE WHEN doc_id % 3 = 0 THEN 'OVERLAP' ELSE 'SAME' END AS outcome FROM documents WHERE doc_id % 10 IN (3, 4, 5))"


@query(f"""WITH {_MERGES}, g AS (SELECT winner, count(*) AS times, bool_or(outcome = 'OVERLAP') AS re, max_by('body ' || loser, loser) AS body, list(source ORDER BY loser) AS more FROM m JOIN documents d ON d.doc_id = loser GROUP BY winner)
SELECT doc_id::VARCHAR AS id, CASE WHEN re THEN 'reviewed' ELSE 'stable' END AS status, (1 + coalesce(times, 0))::INT AS version, coalesce(body, text) AS body_md,
  array_to_string(list_filter([source] || coalesce(more, []), lambda x, i: list_position([source] || coalesce(more, []), x) = i), ',') AS sources
FROM documents LEFT JOIN g ON winner = doc_id WHERE doc_id NOT IN (SELECT loser FROM m)""")
def merge_apply(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    pick = nodes.where("seq % 10 in (3, 4, 5)")
    merges = pick.select(F.col("id").alias("loser"), (F.col("seq") - F.col("seq") % 10).cast("string").alias("winner"), F.when(F.col("seq") % 3 == 0, "OVERLAP").otherwise("SAME").alias("outcome"), F.concat(F.lit("body "), F.col("id")).alias("body_md"), "seq")
    kept, _ = merge.apply_merges(nodes, merges, F.current_timestamp())
    return kept.select("id", "status", "version", "body_md", F.array_join("source_ids", ",").alias("sources"))


@query("SELECT source_id, target, relation FROM (SELECT doc_id::VARCHAR AS source_id, unnest([(doc_id + 1)::VARCHAR, (doc_id + 7)::VARCHAR]) AS target, unnest(['governs', 'same_family']) AS relation FROM documents) UNION SELECT doc_id::VARCHAR, (doc_id + 2)::VARCHAR, 'governs' FROM documents WHERE doc_id + 2 <= (SELECT max(doc_id) FROM documents)")
def link_apply(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    links = index.reindex(nodes)[1]
    new = nodes.select(F.col("id").alias("source_id"), F.explode(F.transform(F.array(F.col("seq") + 1, F.col("seq") + 2, F.col("seq") + 2), lambda x: x.cast("string"))).alias("target"), F.lit("governs").alias("relation"))
    return merge.apply_links(links, new, nodes)


@query(f"SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'C2' ELSE {_LEVEL} END AS cefr, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def relevel_apply(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    approved = nodes.where("seq % 2 = 0").select("id", F.when(F.col("seq") % 4 == 0, "C2").alias("cefr"))
    return merge.apply_changes(nodes, approved, ["cefr"], F.current_timestamp()).select("id", "cefr", "version")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'truncated' WHEN doc_id % 5 = 1 THEN 'empty' WHEN doc_id % 5 = 2 THEN 'unknown-key' WHEN lang = 'es' THEN 'bad-lang' END AS error, CASE WHEN doc_id % 5 >= 3 AND lang <> 'es' THEN n_chars ELSE -1 END AS chars FROM documents")
def strict_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    good = F.to_json(F.struct("lang", F.col("n_chars").alias("chars")))
    answer = F.when(F.col("doc_id") % 5 == 1, " ").when(F.col("doc_id") % 5 == 2, F.to_json(F.struct("lang", "n_chars"))).otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    value, error = models.parse(answer, F.when(F.col("doc_id") % 5 == 0, "length").otherwise("stop"), {"lang": "string", "chars": "long"}, {"lang": ("en", "de", "fr")})
    return d.select("doc_id", error.alias("error"), F.coalesce(value["chars"], F.lit(-1)).alias("chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'stored' ELSE 'chars ' || n_chars END AS answer, doc_id % 2 = 0 AS cached FROM documents")
def cached_model_calls(spark, sf_dir):
    def client(prompts):
        return [(f"chars {len(p)}", "stop") for p in prompts]

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("k"), "doc_id").alias("key"))
    cache = d.where("doc_id % 2 = 0").select("key", F.lit("stored").alias("answer"), F.lit("stop").alias("finish_reason"))
    return models.ask(d, "text", client, cache).select("doc_id", "answer", "cached")


@query("SELECT doc_id, quality, concat_ws(',', CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality / 2.0::DOUBLE < 0.6 THEN 'low-confidence' END) AS flags FROM labels")
def review_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", "quality", F.array_join(merge.flags(F.col("quality") / 2.0, F.when(F.col("toxic") == 1, "toxic")), ",").alias("flags"))
