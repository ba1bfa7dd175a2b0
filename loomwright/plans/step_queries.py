"""Queries of model steps, their caches and what they report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomwright.functions import display
from loomwright.functions.folders import new_folder
from loomwright.operators import dedup, embed, ingest, ledger, models, proposals, steps
from loomwright.operators.adjudicate_run import propose_all, raw_sources
from loomwright.operators.ingest_run import ingest_texts
from loomwright.plans.registry import query, table
from loomwright.sources import files


def _client(prompts):
    """Answers properly once it was refused as often as the id's remainder says: first cut off, then no JSON."""
    out = []
    for p in prompts:
        wanted, refused = int(p.split()[1]), p.count("refused")
        out.append(("{", "length") if refused == 0 and wanted % 4 else ("no", "stop") if refused < wanted % 4 else (f'{{"n": {wanted}}}', "stop"))
    return out


@query("""SELECT doc_id, least(1 + doc_id % 4, 3)::INT AS attempts, CASE WHEN doc_id % 4 < 3 THEN doc_id END AS n, CASE WHEN doc_id % 4 = 3 THEN 'not-json' END AS error FROM documents""")
def retried_answers(spark, sf_dir):
    """A model step whose refused answers are asked again, three times at most."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("id "), "doc_id").alias("prompt"))
    out = models.ask_until(rows, "prompt", _client, lambda answer, reason: models.parse(answer, reason, {"n": "long"}))
    return out.select("doc_id", "attempts", F.col("value.n").alias("n"), "error")


_BROKEN = """e AS (SELECT doc_id, text, doc_id % 10 AS r FROM documents WHERE source <> 'src0')"""


def _cache(spark, sf_dir):
    """Entries of all documents but one source's; some cut off, under a wrong key, of a wrong width, without a vector."""
    d = table(spark, sf_dir, "documents").where("source <> 'src0'").withColumn("r", F.col("doc_id") % 10)
    key = F.when(F.col("r") == 1, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256))
    width = F.when(F.col("r") == 2, F.array(F.lit(1.0))).when(F.col("r") != 3, F.array(F.length("text") * 1.0, F.lit(1.0)))
    line = F.to_json(F.struct(key.alias("key"), F.sha2("text", 256).alias("made_from"), width.alias("embedding")))
    path = new_folder(spark, "cache")
    d.select(F.when(F.col("r") == 0, F.substring(line, 1, 90)).otherwise(line).alias("value")).write.text(path)
    return files.read_cache(spark, path, "key string, made_from string, embedding array<double>", ("made_from", "embedding"), F.col("made_from"), F.size("embedding") == 2)


@query(f"WITH {_BROKEN} SELECT CASE r WHEN 0 THEN 'unreadable' WHEN 1 THEN 'wrong-key' WHEN 2 THEN 'invalid' ELSE 'incomplete' END AS defect, count(*) AS entries FROM e WHERE r <= 3 GROUP BY r")
def broken_cache_entries(spark, sf_dir):
    return _cache(spark, sf_dir)[1].groupBy("defect").agg(F.count("*").alias("entries"))


@query(f"WITH {_BROKEN} SELECT doc_id, text IN (SELECT text FROM e WHERE r > 3) AS hit, length(text) * 1.0::DOUBLE AS first FROM documents")
def cache_mended(spark, sf_dir):
    """Misses, broken entries among them, are asked anew and replace what was there; then all texts are hits."""
    good, _ = _cache(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("key"))
    held = good.select("key", F.lit(True).alias("hit")).distinct()
    missing = d.join(held, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    fresh = missing.select("key", F.col("key").alias("made_from"), F.array(F.length("text") * 1.0, F.lit(1.0)).alias("embedding"))
    after = embed.cache_after(good.dropDuplicates(["key"]), fresh)
    out = d.join(after, "key").join(held, "key", "left")
    return out.select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"), F.col("embedding")[0].alias("first"))


@query("""SELECT o_orderkey, CASE WHEN k = 2 THEN r END AS relation, CASE WHEN k = 2 THEN 'a_to_b' END AS direction, CASE WHEN k = 2 AND r IS NULL THEN 'incoherent' END AS error
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 3 > 0 THEN 'contrasts' END AS r FROM orders)""")
def coherent_verdicts(spark, sf_dir):
    """Relation and direction belong to related texts only, which need both."""
    outcome = F.get(F.array(*map(F.lit, ("SAME", "OVERLAP", "DISTINCT_RELATED", "DISTINCT"))), F.col("o_orderkey") % 4)
    verdict = F.struct(outcome.alias("outcome"), F.when(F.col("o_orderkey") % 3 > 0, "contrasts").alias("relation"), F.lit("a_to_b").alias("direction"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("v"))
    relation, direction, error = models.coherent(F.col("v"))
    return rows.select("o_orderkey", relation.alias("relation"), direction.alias("direction"), error.alias("error"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS prompt_tokens, CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END AS cached_prompt_tokens, 0::BIGINT AS completion_tokens, 7::BIGINT AS total_tokens FROM events")
def provider_usage(spark, sf_dir):
    """Token counts of providers' answers; what one leaves out is 0."""
    details = F.when(F.col("user_id") % 2 == 0, F.format_string('"prompt_tokens_details": {"cached_tokens": %d}, ', F.col("user_id"))).otherwise(F.lit(""))
    said = F.format_string('{"usage": {%s"prompt_tokens": %s, "total_tokens": 7}}', details, F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", models.unpack_usage(said).alias("u")).select("event_id", "u.*")


@query("SELECT doc_id AS id FROM documents WHERE lang = 'de' AND doc_id IN (SELECT vec_id FROM embeddings)")
def focus_overlap(spark, sf_dir):
    """Ids of a focus that the corpus has too."""
    focus = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return dedup.focus_in_corpus(focus, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT doc_id, lang IS NOT NULL AND doc_id % 2 = 1 AS grounded, doc_id % 5 IN (0, 1) AS writes FROM documents")
def proposal_flags(spark, sf_dir):
    """Whether rules alone say a level, and whether a kind writes a body."""
    kind = F.get(F.array(*map(F.lit, ("create", "merge", "link", "relevel", "discard"))), F.col("doc_id") % 5)
    tied = F.when(F.col("doc_id") % 2 == 0, True).when(F.col("doc_id") % 3 == 0, False)
    return table(spark, sf_dir, "documents").select("doc_id", proposals.rules_grounded(F.col("lang"), tied).alias("grounded"), proposals.writes_body(kind).alias("writes"))


@query("""SELECT o_custkey AS doc_id, count(*) AS pages, round(sum(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, 0)), 2) AS cost_usd, sum((o_orderkey % 3 = 0)::INT)::BIGINT AS unpriced,
  array_to_string(list_sort(list('s' || o_orderkey)), ',') AS source_ids FROM orders GROUP BY o_custkey""")
def document_rollup(spark, sf_dir):
    """What the pages of a document cost together, and the sources that they became."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.concat(F.lit("s"), "o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).cast("double").alias("cost_usd"))
    out = ingest.document_rollup(pages)
    return out.select("doc_id", "pages", F.round("cost_usd", 2).alias("cost_usd"), "unpriced", F.array_join(F.array_sort("source_ids"), ",").alias("source_ids"))


def _reader(prompts):
    """Finds as many notes in a text as its length says; its first answer to long texts is cut off."""
    out = []
    for p in prompts:
        said = json.loads(p.split("\n\nThe last answer")[0])[-1]["content"]
        notes = [{"title_de": f"Titel {len(said)} {k}", "title_en": "t", "type": "vocab", "cefr": "B1", "cefr_basis": None, "register": [], "themes": [], "body_md": "b", "confidence": 0.5} for k in range(len(said) % 11)]
        cut = len(said) > 500 and "refused" not in p
        out.append((json.dumps({"candidates": notes})[: 20 if cut else None], "length" if cut else "stop"))
    return out


@query("""SELECT 'sidecar' AS what, count(*) AS n, sum(least(length(text) % 11, 8))::BIGINT AS candidates, sum(length(text))::BIGINT AS chars FROM documents WHERE source <> 'src0'
UNION ALL SELECT 'staged', sum(least(length(text) % 11, 8))::BIGINT, sum(least(length(text) % 11, 8))::BIGINT, NULL FROM documents WHERE source <> 'src0' UNION ALL SELECT 'known', count(*), NULL, NULL FROM documents WHERE source = 'src0'
UNION ALL SELECT 'failed', 0, NULL, NULL""")
def ingest_run(spark, sf_dir):
    """Texts to staged candidates: those of one source were ingested before, all others go through extraction."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").alias("content"), "source")
    old = ingest.source_ids(d.where("source = 'src0'").select("name", "content"), "20260101").select("source_id", "digest")
    taken = spark.createDataFrame([("titel-100-0",)], "id string")
    got = ingest_texts(d.select("name", "content"), _reader, "m", "p", "20260101", F.expr("timestamp'2026-01-02 03:04:05'"), old, taken)
    none = F.lit(None).cast("long")
    rows = got.sidecars.agg(F.lit("sidecar").alias("what"), F.count("*").alias("n"), F.sum("candidate_count").alias("candidates"), F.sum("chars").alias("chars"))
    rows = rows.unionByName(got.staged.agg(F.lit("staged").alias("what"), F.countDistinct("id").alias("n"), F.count("*").alias("candidates"), none.alias("chars")))
    for name, df in (("known", got.known), ("failed", got.failed)):
        rows = rows.unionByName(df.agg(F.lit(name).alias("what"), F.count("*").alias("n"), none.alias("candidates"), none.alias("chars")))
    return rows


def _judge(prompts):
    """A verdict by the length of what it is shown; related pairs of odd length lack a direction at first."""
    out = []
    for p in prompts:
        said = json.loads(p.split("\n\nThe last answer")[0])[-1]["content"]
        outcome = steps.OUTCOMES[len(said) % 4]
        out.append((json.dumps({"outcome": outcome, "relation": "governs", "direction": None if len(said) % 8 > 3 and "refused" not in p else "a_to_b"}), "stop"))
    return out


_SHOWN = "'A: ' || p_name || ' ()' || chr(10) || 'type: vocab | cefr: A1' || chr(10) || chr(10) || trim(p_name) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'B: ' || p_name || ' (x)' || chr(10) || 'type:  | cefr: ' || chr(10) || chr(10) || repeat('b', (p_partkey % 9)::INT)"


@query(f"""SELECT p_partkey, ['SAME', 'OVERLAP', 'DISTINCT_RELATED', 'DISTINCT'][1 + n % 4] AS outcome, CASE WHEN n % 4 = 2 THEN 'governs' END AS relation, CASE WHEN n % 4 = 2 THEN 'a_to_b' END AS direction, CASE WHEN n % 8 = 6 THEN 2 ELSE 1 END::INT AS attempts
FROM (SELECT p_partkey, length({_SHOWN}) AS n FROM part)""")
def adjudicate_step(spark, sf_dir):
    """Pairs shown to a model, its verdicts checked for sense, and those that lack a direction asked again."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    none = F.lit(None).cast("string")
    a = steps.render("A", F.col("p_name"), none, F.lit("vocab"), F.lit("A1"), F.col("p_name"))
    b = steps.render("B", F.col("p_name"), F.lit("x"), none, none, F.repeat(F.lit("b"), (F.col("p_partkey") % 9).cast("int")))
    out = steps.run(rows, steps.ADJUDICATE, steps.pair_text(a, b), _judge, "m")
    return out.select("p_partkey", "value.outcome", "value.relation", "value.direction", "attempts")


def _writer(prompts):
    """Keeps A's text as an example, and invents one where the prompt says that B adds something."""
    out = []
    for p in prompts:
        said = json.loads(p.split("\n\nThe last answer")[0])[-1]["content"]
        kept = said.split("\n\n")[1].splitlines()[0]
        out.append((json.dumps({"body_md": "## Examples\n- " + kept + ("\n- invented here" if "B adds: " in said else ""), "changelog": "log"}), "stop"))
    return out


@query("SELECT 'c' || p_partkey AS candidate, 'n' || p_partkey AS other, p_partkey % 3 = 0 AS unsourced, sha256('## Examples' || chr(10) || '- ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '- invented here' ELSE '' END) AS body_sha256 FROM part")
def regenerate_step(spark, sf_dir):
    """New bodies of overlapping pairs, and which of them have an example that no source has."""
    none = F.lit(None).cast("string")
    shown = steps.render("A", F.lit("t"), none, none, none, F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), "p_partkey").alias("candidate"), F.concat(F.lit("n"), "p_partkey").alias("other"), shown.alias("a"), F.lit("B").alias("b"), F.when(F.col("p_partkey") % 3 == 0, "more").alias("b_adds"), F.array("p_name").alias("sources"))
    return steps.regenerated(rows, _writer, "m").select("candidate", "other", "unsourced", F.sha2("body_md", 256).alias("body_sha256"))


@query(r"""SELECT doc_id, (2 + (lang = 'de')::INT)::INT AS added, 1::INT AS removed, true AS marked FROM documents""")
def body_diffs(spark, sf_dir):
    """What a review shows of two versions of a body: a line changed, one put at the end, for some another one before it."""
    d = table(spark, sf_dir, "documents")
    rest = F.concat(F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    after = F.concat(F.lit("changed"), rest, F.when(F.col("lang") == "de", "\nnoch eine").otherwise(""), F.lit("\nlast line"))
    rows = d.select("doc_id", display.body_diff(F.concat(F.lit("first"), rest), after).alias("lines"))
    marks = lambda sign: F.size(F.filter("lines", lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return rows.select("doc_id", marks("+").alias("added"), marks("-").alias("removed"), (F.array_contains("lines", "-first") & F.array_contains("lines", "+changed")).alias("marked"))


@query("""SELECT doc_id, 'raw/s' || doc_id || '.txt' AS text_path, 'raw/s' || doc_id || '.json' AS sidecar_path, 'raw/s' || doc_id || '.png' AS artifact, 'cache/own-model-1/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.json' AS vector_path,
  'cache/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.json' AS answer_path, 'proposals/p' || doc_id || '.md' AS proposal FROM documents""")
def stored_paths(spark, sf_dir):
    """Where a source, its artifact, its cache entries and a proposal lie."""
    source, key = F.concat(F.lit("s"), "doc_id"), F.sha2("text", 256)
    text, sidecar = display.raw_paths(source, "raw")
    paths = {"text_path": text, "sidecar_path": sidecar, "artifact": display.artifact_path(source, F.when(F.col("doc_id") % 2 == 0, ".PNG").otherwise("png"), "raw"), "vector_path": display.cache_path(key, "cache", "Own/Model_1"), "answer_path": display.cache_path(key, "cache"), "proposal": display.proposal_path(F.concat(F.lit("p"), "doc_id"), "proposals")}
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in paths.items()))


@query("SELECT count(DISTINCT vec_id) AS vectors FROM embeddings")
def stored_vector_count(spark, sf_dir):
    """How many nodes have a vector."""
    return embed.stored_ids(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"))).agg(F.count("*").alias("vectors"))


@query("""SELECT coalesce(event_type, 'total') AS label, count(*)::VARCHAR AS calls, format('{:,}', sum(user_id)::BIGINT) AS completion, CASE WHEN event_type = 'view' THEN '100%' WHEN event_type IS NULL THEN round_even(100.0 * sum((event_type = 'view')::INT) / count(*), 0)::INT || '%' ELSE '0%' END AS hit_rate,
  printf('$%.6f', round(sum(value), 2)) AS cost FROM events GROUP BY ROLLUP (event_type)""")
def usage_report_lines(spark, sf_dir):
    """The usage report as people read it, groups by name, the total last."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), (F.col("event_type") == "view").alias("cached"), *(F.lit(0).cast("long").alias(c) for c in ("prompt_tokens", "cached_prompt_tokens", "total_tokens")), F.col("user_id").alias("completion_tokens"), F.col("value").alias("cost_usd"), F.lit(0.0).alias("saved_usd"))
    report = ledger.usage_report(e, "step").withColumn("cost_usd", F.round("cost_usd", 2))
    return display.usage_lines(report).select("label", "calls", "completion", "hit_rate", "cost")


_TOLD = """w AS (SELECT p_partkey AS p, p_name, 'c' || p_partkey AS c, 'n' || p_partkey AS n, (p_partkey % 100) / 100.0::DOUBLE AS s, p_partkey % 11 = 0 AS decided, p_partkey % 7 = 0 AS capped,
  length('A: ' || p_name || ' (x)' || chr(10) || 'type: vocab | cefr: A1' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'B: ' || p_name || ' (x)' || chr(10) || 'type: vocab | cefr: A1' || chr(10) || chr(10) || p_name || repeat('b', (p_partkey % 9)::INT)) AS size FROM part),
v AS (SELECT *, CASE WHEN s >= 0.95 THEN 'SAME' ELSE ['SAME', 'OVERLAP', 'DISTINCT_RELATED', 'DISTINCT'][1 + size % 4] END AS outcome FROM w)"""


def _adjudicator(prompts):
    """Judges pairs as ``_judge`` does and writes bodies as ``_writer`` does, by what it is asked."""
    return [(_writer if "write one note" in p else _judge)([p])[0] for p in prompts]


@query(f"""WITH {_TOLD} SELECT kind, outcome, count(*) AS n, sum(paired)::BIGINT AS paired, sum(llm)::BIGINT AS by_model FROM (
  SELECT CASE WHEN outcome = 'OVERLAP' AND capped THEN 'discard' ELSE 'merge' END AS kind, CASE WHEN outcome = 'OVERLAP' AND capped THEN 'MANUAL' ELSE outcome END AS outcome, 1 AS paired, (s < 0.95)::INT AS llm FROM v WHERE NOT decided AND outcome IN ('SAME', 'OVERLAP')
  UNION ALL SELECT 'link', outcome, 0, 1 FROM v WHERE NOT decided AND outcome = 'DISTINCT_RELATED'
  UNION ALL SELECT 'create', 'DISTINCT', 0, 0 FROM v WHERE decided OR outcome IN ('DISTINCT_RELATED', 'DISTINCT')) x GROUP BY ALL""")
def adjudicate_run(spark, sf_dir):
    """Pairs to complete proposals through both model steps, with decided pairs, winners at their cap, and lone candidates."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    row = lambda letter, body: part.select(F.concat(F.lit(letter), "p_partkey").alias("id"), F.col("p_name").alias("title_de"), F.lit("x").alias("title_en"), F.lit("vocab").alias("type"), F.lit("A1").alias("cefr"), F.array(F.concat(F.lit("s"), "p_partkey")).alias("source_ids"), body.alias("body_md"), F.lit(1).alias("version"))
    nodes = row("n", F.col("p_name"))
    candidates = row("c", F.concat("p_name", F.repeat(F.lit("b"), (F.col("p_partkey") % 9).cast("int")))).drop("version").withColumns({"source_id": F.lit("src"), "path": F.lit("queue")})
    c, n, text = F.concat(F.lit("c"), "p_partkey"), F.concat(F.lit("n"), "p_partkey"), lambda x: F.lit(x)
    pairs = part.select(c.alias("candidate"), n.alias("other"), F.lit(1).alias("rank"), (F.col("p_partkey") % 100 / 100.0).alias("similarity"), text("semantic").alias("tier"), text("gray").alias("band"))
    # five approved overlaps of a node are its cap; a rejected merge decides its pair
    past = part.where("p_partkey % 7 = 0").select(n.alias("winner"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select(F.lit(True).alias("approved"), text("OVERLAP").alias("outcome"), "winner", F.concat(F.lit("old"), "k").alias("loser"))
    past = past.unionByName(part.where("p_partkey % 11 = 0").select(F.lit(False).alias("approved"), text("SAME").alias("outcome"), n.alias("winner"), c.alias("loser")))
    raw = part.select(F.concat(F.lit("s"), "p_partkey").alias("source_id"), F.col("p_name").alias("text"))
    got = propose_all(pairs, candidates, nodes, past, raw, _adjudicator, "m", "p", F.expr("timestamp'2026-01-02 03:04:05'"))
    out = got.proposals.join(got.failed.select("candidate").distinct(), "candidate", "left_anti")
    return out.groupBy("kind", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("winner").isNotNull()).alias("paired"), F.count_if(F.coalesce(F.col("basis") == "llm", F.lit(False))).alias("by_model"))


@query("SELECT doc_id AS id, true AS same, 1 + (source IN ('src1', 'src2'))::INT + (lang = 'de')::INT AS texts FROM documents")
def texts_behind_nodes(spark, sf_dir):
    """A node's body and the raw texts of its sources, in their order; sources without a text add none."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("source", "lang").alias("source_ids"), F.col("text").alias("body_md"))
    raw = spark.createDataFrame([(x, f"raw {x}") for x in ("src1", "src2", "de")], "source_id string, text string")
    got = raw_sources(nodes, raw).join(nodes, "id")
    want = F.filter(F.array("body_md", F.when(F.col("source_ids")[0].isin("src1", "src2"), F.concat(F.lit("raw "), F.col("source_ids")[0])), F.when(F.col("source_ids")[1] == "de", "raw de")), lambda x: x.isNotNull())
    return got.select("id", (F.col("texts") == want).alias("same"), F.size("texts").alias("texts"))


@query("SELECT doc_id AS id, CASE WHEN change = in_nodes THEN 'accepted' ELSE 'refused' END AS state, change FROM (SELECT doc_id, unnest([true, false]) AS change, doc_id IN (SELECT vec_id FROM embeddings) AS in_nodes FROM documents)")
def write_gate(spark, sf_dir):
    """Changes of nodes that must be there, and creations of nodes that must not."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    parts = [df.select("id", F.lit(state).alias("state"), F.lit(change).alias("change")) for change in (True, False) for df, state in zip(ingest.gate(rows, nodes, change), ("accepted", "refused"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
