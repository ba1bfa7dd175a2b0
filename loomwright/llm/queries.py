"""Queries of the training-data operators: thin, each through its operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import chat, hamming, html_main, lang_id, mixing, neardup, pii, prefix_bpe, recipes, sharding, syncmers, token_counts, vector_codes
from loomwright.llm.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_odd_sketch_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 4-word shingles at similarity 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query("op6_word_backoff_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    held = F.coalesce(held, F.lit(False))
    model = lang_id.fit(docs.where(~held), order_by=F.col("doc_id"))
    out = lang_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_pretoken_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents for a limit of 512 tokens."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), file.read(), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op9_prefix_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    ranks = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = prefix_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_max_run_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, with weights learned from pages that label their article."""
    pages = table(spark, sf_dir, "pages")
    text = html_main.extract(pages, html_main.learn(pages))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_closed_syncmers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    out = syncmers.compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_text(F.col("fingerprint")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op4_weak_supervision_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base finds and what the trained classifier adds."""
    scanned = written(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "scanned")
    out = pii.decide(scanned, pii.train(scanned))
    counts = [pii.count_kind(F.col("pii_base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(pii.as_text(F.col("pii_base")), 256).alias("base_sha256"), pii.as_text(F.col("pii_spans")).alias("spans"))


def _mix_oracle() -> str:
    """Raking in SQL: a recursive table of cell weights, fitted by window sums."""
    def case(column: str, targets: dict[str, float]) -> str:
        return f"CASE WHEN {column} IN ({', '.join(repr(n) for n in targets if n != '*')}) THEN {column} ELSE '*' END"

    goals = {k: ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in t.items()) for k, t in recipes.TARGETS.items()}
    sweep = "rows"
    for key, col in (("source", "s"), ("lang", "l"), ("topic", "t")):
        sweep = f"""(SELECT k, s, l, t, n, gs, gl, gt, w * g{col} / sum(w) OVER (PARTITION BY k, {col}) AS w FROM {sweep} x)"""
    sweep = sweep.replace("FROM rows x", "FROM (SELECT k + 1 AS k, s, l, t, n, gs, gl, gt, w FROM fit WHERE k < 60) x")
    return rf"""
    WITH RECURSIVE docs AS (
      SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x09\x0A\x0D\x20]+')) AS n_tokens FROM documents),
    named AS (
      SELECT *, CASE WHEN contains(text, 'License') OR contains(text, 'Copyright') OR contains(text, 'copyright') THEN 'legal'
        WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact' WHEN n_tokens < 150 THEN 'short' WHEN n_tokens >= 1200 THEN 'long' ELSE 'prose' END AS topic FROM docs),
    keyed AS (SELECT *, {case('source', recipes.TARGETS['source'])} AS s, {case('lang', recipes.TARGETS['lang'])} AS l, {case('topic', recipes.TARGETS['topic'])} AS t FROM named),
    cells AS (SELECT s, l, t, sum(n_tokens)::DOUBLE AS n FROM keyed GROUP BY ALL HAVING sum(n_tokens) > 0),
    gs AS (SELECT a, b / sum(b) OVER () AS g FROM (VALUES {goals['source']}) v(a, b) WHERE a IN (SELECT s FROM cells)),
    gl AS (SELECT a, b / sum(b) OVER () AS g FROM (VALUES {goals['lang']}) v(a, b) WHERE a IN (SELECT l FROM cells)),
    gt AS (SELECT a, b / sum(b) OVER () AS g FROM (VALUES {goals['topic']}) v(a, b) WHERE a IN (SELECT t FROM cells)),
    fit AS (
      SELECT 0 AS k, s, l, t, n, gs.g AS gs, gl.g AS gl, gt.g AS gt, n AS w FROM cells JOIN gs ON s = gs.a JOIN gl ON l = gl.a JOIN gt ON t = gt.a
      UNION ALL
      SELECT k, s, l, t, n, gs, gl, gt, w FROM {sweep} y),
    gains AS (SELECT s, l, t, w / n * sum(n) OVER () / sum(w) OVER () AS gain FROM fit WHERE k = 60)
    SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(coalesce(gain, 0), 6) AS gain, round(coalesce(p, 0), 6) AS probability,
      ('0x' || substr(md5(doc_id || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(p, 0) AS selected
    FROM (SELECT *, gain / (SELECT max(gain) FROM gains) AS p
          FROM keyed LEFT JOIN gains ON keyed.s = gains.s AND keyed.l = gains.l AND keyed.t = gains.t AND n_tokens > 0)
    """


@query("op2_raked_mixture", _mix_oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the probability that calibrates the mixture, and what is sampled."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, recipes.TARGETS, recipes.topic(F.col("text"), F.col("mix_tokens")), mixing.n_tokens(F.col("text")))
    return out.select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_gain", 6).alias("gain"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_selected").alias("selected"),
    )


_CHAT_ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
sized AS (
  SELECT *, len(regexp_extract_all(text, '\\|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[ANS\]|</s>|\[ROLE\]|\[:\]|\[/ROLE\]')) + length(text)
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM sized GROUP BY conv_id
"""


@query("op3_chat_format", _CHAT_ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_conversations(own.unionByName(more)).withColumn("back", chat.read_back(F.col("formatted")))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_TOP_K_ORACLE = """
WITH codes AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i] > 0) AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id,
    len(list_filter(range(1, 65), lambda i: q.code[i] <> x.code[i]))::BIGINT AS distance
  FROM codes q JOIN codes x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op1_multi_index_top_k", _TOP_K_ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id 50 divides, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 50 = 0"), k=10)


@query("op11_balanced_label_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts, equal texts together where a shard can hold them."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "text", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.balanced_shards(docs, sharding.text_key(F.col("text")), keep=("doc_id", "size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _codes_oracle() -> str:
    """Training and coding in SQL: every part against every entry, in integers."""
    def coded(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
          SELECT row, part, min(apart * 64 + entry) % 64 AS entry, min(apart * 64 + entry) // 64 AS apart, any_value(v) AS v FROM (
            SELECT row, p.part, entry, p.v, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT AS apart
            FROM parts p JOIN book{k} b ON p.part = b.part) x GROUP BY row, part)"""

    def book(k: int) -> str:
        return f"""mean{k} AS (
          SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
            SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k - 1}, range(1, 17) r(i) WHERE i <= len(v) GROUP BY part, entry, i) x GROUP BY part, entry),
        book{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k - 1} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry)"""

    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT row, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS v FROM kept, range(16) r(part)),
    seeds AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
    book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN seeds USING (row)),
    {coded(0)}, {book(1)}, {coded(1)}, {book(2)}, {coded(2)},
    sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS s FROM book2),
    codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error FROM near2 GROUP BY row)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM codes JOIN kept USING (row), sha
    """


@query("op12_screened_product_codes", _codes_oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, by codebooks of 64 entries a part trained in two rounds."""
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))
