"""Queries of duplicate detection and of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import dedup, merge
from loomwright.plans.registry import NORM, WORDS, query, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_HASHED = f"hashed AS (SELECT doc_id AS id, lang, sha256({NORM.format('text')}) AS hash FROM documents)"
_EXACT = "SELECT a.id AS left_id, b.id AS right_id, 1.0::DOUBLE AS similarity FROM hashed a JOIN hashed b ON a.hash = b.hash AND a.id < b.id"
_NEAR = f"""norm AS (SELECT doc_id AS id, lang, {NORM.format('text')} AS t FROM documents),
grams AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(CASE WHEN length(t) > 5 THEN list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)) WHEN t = '' THEN [] ELSE [t] END) AS g FROM norm)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS l, b.id AS r, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
near AS (SELECT l AS left_id, r AS right_id, i::DOUBLE / (x.n + y.n - i) AS similarity FROM common JOIN sizes x ON x.id = l JOIN sizes y ON y.id = r
  WHERE i::DOUBLE / (x.n + y.n - i) >= 0.85 AND NOT EXISTS (SELECT 1 FROM norm p JOIN norm q ON p.t = q.t WHERE p.id = l AND q.id = r))"""
_COS = """cos AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM cos QUALIFY rank <= 10)"""


@query(f"WITH {_HASHED} SELECT *, 'duplicate' AS band FROM ({_EXACT})")
def exact_duplicate_pairs(spark, sf_dir):
    pairs = dedup.exact_pairs(_documents(spark, sf_dir))
    return pairs.withColumn("band", dedup.band(F.col("similarity")))


@query(f"WITH {_HASHED} SELECT hash, min(id) AS first_id, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs FROM hashed GROUP BY hash HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return dedup.exact_groups(_documents(spark, sf_dir))


@query(f"WITH norm AS (SELECT doc_id AS id, {NORM.format('text')} AS t FROM documents) SELECT id, CASE WHEN t = '' THEN 0 WHEN length(t) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) END::BIGINT AS n_shingles FROM norm")
def shingle_stats(spark, sf_dir):
    return dedup.shingle_sizes(_documents(spark, sf_dir))


@query(f"WITH {_NEAR} SELECT left_id, right_id, round(similarity, 9) AS similarity, CASE WHEN similarity >= 0.95 THEN 'duplicate' ELSE 'gray' END AS band FROM near")
def near_exact_pairs(spark, sf_dir):
    pairs = dedup.near_exact_pairs(_documents(spark, sf_dir))
    return pairs.select("left_id", "right_id", F.round("similarity", 9).alias("similarity"), dedup.band(F.col("similarity")).alias("band"))


@query(f"WITH {_HASHED} SELECT * FROM ({_EXACT} AND (a.lang = 'de' OR b.lang = 'de'))")
def focus_vs_corpus(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = dedup.corpus_of(docs.where("lang = 'de'"), docs)
    return dedup.exact_pairs(rows)


@query(f"WITH {_COS} SELECT id, other, similarity, rank FROM ranked")
def knn_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return dedup.nearest(vectors, vectors, k=10)


@query(f"WITH {_COS} SELECT least(id, other) AS left_id, greatest(id, other) AS right_id, max(similarity) AS similarity FROM ranked WHERE similarity >= 0.35 GROUP BY ALL")
def semantic_pairs(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return dedup.semantic_pairs(vectors, vectors, low=0.35)


@query(f"WITH {_COS}, pairs AS (SELECT DISTINCT least(id, other), greatest(id, other), similarity FROM ranked WHERE similarity >= 0.35) SELECT CASE WHEN similarity >= 0.45 THEN 'duplicate' ELSE 'gray' END AS band, count(*) AS pairs FROM pairs GROUP BY 1")
def band_counts(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    pairs = dedup.semantic_pairs(vectors, vectors, low=0.35)
    return pairs.groupBy(dedup.band(F.col("similarity"), 0.45).alias("band")).agg(F.count("*").alias("pairs"))


@query(f"""WITH {_HASHED}, {_NEAR}, {_COS}, ex AS ({_EXACT}),
early AS (SELECT left_id, right_id, 'exact' AS tier, similarity FROM ex UNION ALL SELECT left_id, right_id, 'near-exact', similarity FROM near),
sem AS (SELECT least(id, other) AS left_id, greatest(id, other) AS right_id, max(similarity) AS similarity FROM ranked WHERE similarity >= 0.35 AND id IN (SELECT doc_id FROM documents) AND other IN (SELECT doc_id FROM documents) GROUP BY ALL),
every AS (SELECT * FROM early UNION ALL SELECT left_id, right_id, 'semantic', similarity FROM sem ANTI JOIN early USING (left_id, right_id))
SELECT left_id, right_id, tier, round(similarity, 6) AS similarity, CASE WHEN similarity >= 0.95 THEN 'duplicate' ELSE 'gray' END AS band FROM every""")
def dedup_report(spark, sf_dir):
    out = dedup.report(_documents(spark, sf_dir).select("id", "text"), _vectors(spark, sf_dir), low=0.35)
    return dedup.report_order(out.withColumn("similarity", F.round("similarity", 6)))


_STRIP = r"""list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '^[#|]') AND NOT regexp_matches(s, '^[-|: ]*$')),
  lambda s: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^[-*+]\s+', ''), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`(.+?)`', '\1', 'g'), '\[(.+?)\]', '', 'g')))"""


@query(f"SELECT doc_id, array_to_string(list_filter({_STRIP}, lambda s: s <> ''), ' ') AS prose FROM documents")
def strip_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_markdown(F.col("text")).alias("prose"))


@query(f"SELECT doc_id, trim(concat('query: ', trim(source), CASE WHEN p = '' THEN '' ELSE '. ' || p END)) AS embed_text FROM (SELECT doc_id, source, array_to_string(list_filter({_STRIP}, lambda s: s <> ''), ' ') AS p FROM documents)")
def embed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.embed_text(F.col("source"), F.col("text")).alias("embed_text"))


def _bodies(spark, sf_dir):
    """Node bodies from conversations: every line of a text is an example of its role."""
    rows = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("Intro.\n- none\n## Examples\n- "), F.replace("text", F.lit("\n"), F.lit(" (gloss) [alltag]\n- ")), F.lit("\n## Next\n- out\n"))
    return rows.select("conv_id", "turn", "role", "text", body.alias("body"))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT conv_id, turn, array_to_string({_LINES}, '|') AS examples FROM conversations")
def example_extraction(spark, sf_dir):
    return _bodies(spark, sf_dir).select("conv_id", "turn", F.array_join(T.example_lines(F.col("body")), "|").alias("examples"))


_FOLDED = WORDS.format("x")


@query(f"""WITH src AS (SELECT conv_id, {WORDS.format("coalesce(string_agg(text, chr(10) ORDER BY turn), '')")} AS hay FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn, array_to_string(list_filter({_LINES}, lambda x: {_FOLDED} <> '' AND NOT contains(coalesce(hay, ''), {_FOLDED})), '|') AS unsourced
FROM conversations c LEFT JOIN src USING (conv_id) WHERE role <> 'system'""")
def unsourced_examples(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    sources = bodies.where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("sources"))
    rows = bodies.where("role <> 'system'").join(sources, "conv_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.array_join(merge.unsourced_examples(F.col("body"), F.col("sources")), "|").alias("unsourced"))


@query(f"""WITH w AS (SELECT conv_id, list_transform({_LINES}, lambda x: {_FOLDED}) AS have FROM conversations WHERE turn = 1)
SELECT c.conv_id, c.turn, array_to_string(list_filter({_LINES}, lambda x: NOT list_contains(have, {_FOLDED})), '|') AS fresh FROM conversations c JOIN w USING (conv_id) WHERE turn > 1""")
def new_examples(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    winners = bodies.where("turn = 1").select("conv_id", F.col("body").alias("winner"))
    rows = bodies.where("turn > 1").join(winners, "conv_id")
    return rows.select("conv_id", "turn", F.array_join(merge.new_examples(F.col("winner"), F.col("body")), "|").alias("fresh"))


_SLUG = r"CASE WHEN {0} = '' THEN '{1}' ELSE {0} END"


def _slug_sql(text: str, longest: int, fallback: str) -> str:
    dashed = rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-')"
    return _SLUG.format(f"trim(substr({dashed}, 1, {longest}), '-')", fallback)


_ASCII = f"translate(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'), '{T.MARKED}', '{T.BARE}')"


@query(f"SELECT doc_id, {_slug_sql(_ASCII, 40, 'quelle')} AS slug FROM documents")
def slug_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, {_slug_sql('text', 60, 'konzept')} AS slug FROM documents")
def node_slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.node_slug(F.col("text")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'link-' || p_name_slug || '-' || substr(sha256('link|' || p_name_slug || '|s' || l_suppkey || '|governs'), 1, 8) AS proposal_id FROM (SELECT *, replace(p_name, ' ', '-') AS p_name_slug FROM lineitem JOIN part ON l_partkey = p_partkey)")
def proposal_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    other = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", T.proposal_id(F.lit("link"), F.replace("p_name", F.lit(" "), F.lit("-")), other, F.lit("governs")).alias("proposal_id"))


@query("SELECT page_id, 'sha256:' || sha256(html) AS redacted, 'data:text/html;base64,' || to_base64(encode(url)) AS uri FROM pages")
def redacted_data_uris(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    whole = T.data_uri(F.lit("text/html"), F.encode("html", "UTF-8"))
    return pages.select("page_id", T.redact_data_uri(whole).alias("redacted"), T.data_uri(F.lit("text/html"), F.encode("url", "UTF-8")).alias("uri"))


@query(r"""SELECT conv_id, turn, trim(text) AS unfenced FROM conversations""")
def unfenced_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("  ```json\n"), F.trim("text"), F.lit("\n```  "))
    return rows.select("conv_id", "turn", T.strip_fences(fenced).alias("unfenced"))
