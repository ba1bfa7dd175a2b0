"""Queries that write files of the corpus to a new shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import new_folder
from loomwright.operators import index, ingest, morph, proposals
from loomwright.plans.corpus_queries import _nodes, _usage
from loomwright.plans.registry import query, table
from loomwright.schemas import DECISION, NODE, PROPOSAL, USAGE
from loomwright.sources import files, nodes, snapshots
from loomwright.sources.named_files import write_files


def _typed(df, ddl: str, **values):
    """``df`` with the columns of a row type; what is not given is null."""
    fields = df.sparkSession.createDataFrame([], ddl).schema.fields
    return df.select(*(F.coalesce(values[f.name]).cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def _documents_as_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return _typed(
        d, NODE, id=F.concat(F.lit("n"), "doc_id"), title_de=F.concat(F.lit("Titel: "), "doc_id"), title_en=F.lit("#1 'quoted'"), type=F.lit("vocab"), cefr=F.lit("A2"), themes=F.array("source", "lang"), links=F.array(F.struct(F.lit("n1").alias("target"), F.lit("governs").alias("relation"), F.lit(None).cast("double").alias("confidence"))),
        source_ids=F.array("source"), status=F.lit("draft"), version=F.lit(1), body_md=F.concat(F.lit("Body of "), "doc_id", F.lit("\n\n- one"), F.when(F.col("doc_id") % 2 == 0, F.lit("\n- öl & --- : x")).otherwise(F.lit(""))),
    )


@query("""SELECT 'n' || doc_id AS id, 'Titel: ' || doc_id AS title_de, '#1 ''quoted''' AS title_en, source || '|' || lang AS themes, 'n1' AS target, sha256('Body of ' || doc_id || chr(10) || chr(10) || '- one' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- öl & --- : x' ELSE '' END) AS body_sha256 FROM documents""")
def node_files_read_back(spark, sf_dir):
    """Every document as a node file of its own, written by tasks, and the files read as nodes."""
    folder = new_folder(spark, "nodes")
    nodes.write_nodes(_documents_as_nodes(spark, sf_dir), folder)
    got = nodes.read_nodes(spark, folder)
    return got.select("id", "title_de", "title_en", F.array_join("themes", "|").alias("themes"), F.col("links")[0]["target"].alias("target"), F.sha2("body_md", 256).alias("body_sha256"))


@query("SELECT source AS source_id, count(*) AS files, min('n' || doc_id) AS first FROM documents GROUP BY source")
def queue_files(spark, sf_dir):
    """Staged candidates in a folder for each source, and what the folders hold."""
    folder = new_folder(spark, "queue")
    nodes.write_queue(_documents_as_nodes(spark, sf_dir).withColumn("source_id", F.col("source_ids")[0]), folder)
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    return held.groupBy(F.element_at(parts, -2).alias("source_id")).agg(F.count("*").alias("files"), F.min(F.regexp_replace(F.element_at(parts, -1), r"\.md$", "")).alias("first"))


@query("SELECT doc_id::VARCHAR AS name, sha256(text) AS digest FROM documents")
def raw_texts_read_back(spark, sf_dir):
    """Every text as a file of its own, and the files read; a document without a text (or an id) has none, and stays as it is."""
    folder = new_folder(spark, "raw")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    write_files(d.where("name is not null and text is not null").select(F.concat("name", F.lit(".txt")).alias("name"), "text"), folder)
    got = files.read_texts(spark, folder)
    got = got.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name"), T.content_hash(F.col("text")).alias("digest"))
    return got.unionByName(d.where("name is null or text is null").select("name", T.content_hash(F.col("text")).alias("digest")))


@query("""SELECT 's' || doc_id AS source_id, doc_id % 3 <> 0 AS has_text, doc_id % 2 = 0 AS has_sidecar, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS chars, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN doc_id::INT END AS page,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 9 ELSE 8 END END AS n_keys FROM documents""")
def sidecars_by_id(spark, sf_dir):
    """Sidecars as files: constant keys always, others only if they say something; raw texts and sidecars by id."""
    folder = new_folder(spark, "sidecars")
    d = table(spark, sf_dir, "documents").withColumn("source_id", F.concat(F.lit("s"), "doc_id"))
    side = _typed(d.where("doc_id % 2 = 0"), files.SIDECAR, source_id=F.col("source_id"), chars=F.col("n_chars"), page=F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")))
    files.write_sidecars(side, folder)
    back = files.with_sidecars(d, d.where("doc_id % 3 <> 0"), files.read_sidecars(spark, folder))
    keys = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("source_id"), F.size(F.json_object_keys(F.decode("content", "utf-8"))).alias("n_keys"))
    out = back.join(keys, "source_id", "left")
    return out.select("source_id", F.col("text").isNotNull().alias("has_text"), F.col("sidecar").isNotNull().alias("has_sidecar"), "sidecar.chars", "sidecar.page", "n_keys")


@query("SELECT event_type AS step, count(*) AS calls, sum(CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END)::BIGINT AS completion_tokens, round(sum(CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END), 4) AS cost_usd, 0::BIGINT AS before FROM events GROUP BY event_type")
def usage_ledger_read_back(spark, sf_dir):
    """Calls appended in two parts to a ledger of JSON lines, and read; a ledger that is not there is empty."""
    path = new_folder(spark, "usage")
    usage = _usage(spark, sf_dir)
    rows = _typed(usage, USAGE, **{c: F.col(c) for c in usage.columns})
    before = files.read_usage(spark, path).count()
    for part in ("cached", "not cached"):
        files.append_ledger(rows.where(part), path)
    got = files.read_usage(spark, path)
    return got.groupBy("step").agg(F.count("*").alias("calls"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.lit(before).cast("long").alias("before"))


@query("SELECT 'd' || o_orderkey AS decision_id, o_orderkey % 3 = 0 AS approved, 'w' || o_custkey AS winner FROM orders")
def decision_ledger_read_back(spark, sf_dir):
    path = new_folder(spark, "decisions")
    o = table(spark, sf_dir, "orders")
    files.append_ledger(_typed(o, DECISION, decision_id=F.concat(F.lit("d"), "o_orderkey"), approved=F.col("o_orderkey") % 3 == 0, winner=F.concat(F.lit("w"), "o_custkey"), kind=F.lit("merge")), path)
    return files.read_decisions(spark, path).select("decision_id", "approved", "winner")


@query("SELECT 'p' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS reason FROM orders")
def proposals_read_back(spark, sf_dir):
    """Pending proposals written with new ones, which replace those of their id, and read."""
    o = table(spark, sf_dir, "orders")
    rows = lambda df, why: _typed(df, PROPOSAL, id=F.concat(F.lit("p"), "o_orderkey"), kind=F.lit("merge"), reason=F.lit(why), similarity=F.lit(0.5))
    path = new_folder(spark, "proposals")
    proposals.write_proposals(rows(o, "old"), rows(o.where("o_orderkey % 2 = 0"), "new"), path)
    return proposals.listing(proposals.read_proposals(spark, path)).select("id", "reason")


_LISTS = r"words AS (SELECT DISTINCT ['a1','a2','b1','b2','c1','c2'][1 + (doc_id % 6)::INT] AS file, unnest(regexp_extract_all(text, '\p{L}+')) AS lemma FROM documents)"


@query(f"WITH {_LISTS} SELECT lemma, upper(file) AS level FROM words")
def wordlists_read_back(spark, sf_dir):
    """Word lists of six levels as files with comments and blanks, and read as one table."""
    folder = new_folder(spark, "wordlists")
    d = table(spark, sf_dir, "documents")
    name = F.get(F.array(*(F.lit(f"{x}.txt") for x in ("a1", "a2", "b1", "b2", "c1", "c2"))), F.col("doc_id") % 6)
    words = d.select(name.alias("name"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("lemma")).distinct()
    # a list is one file, whose lines are bounded by the language
    lists = words.groupBy("name").agg(F.concat(F.lit("# words\n\n"), F.array_join(F.transform(F.collect_list("lemma"), lambda w: F.concat(F.lit(" "), w)), "\n")).alias("text"))
    write_files(lists, folder)
    return files.read_wordlists(spark, folder)


@query("SELECT doc_id, CASE lower(source) WHEN 'src1' THEN 'news' WHEN 'src2' THEN 'news' ELSE lower(source) END AS tag, lower(source) IN ('src3', 'src4') AS known FROM documents")
def tags_by_vocabulary(spark, sf_dir):
    """Tags through an alias file and a list of known ones, both read from files."""
    folder = new_folder(spark, "vocabulary")
    lines = spark.range(1).select(F.explode(F.array(F.struct(F.lit("aliases.txt").alias("name"), F.lit("# alias: tag\nSRC1: news\n 'src2' :  News # both\n\n").alias("text")), F.struct(F.lit("themes.txt").alias("name"), F.lit("src3\n  SRC4 \n# none\n").alias("text")))).alias("f"))
    write_files(lines.select("f.*"), folder)
    tags = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), F.upper("source"), F.lit(" ")).alias("tag"))
    known = files.read_tags(spark, f"{folder}/themes.txt").withColumn("known", F.lit(True))
    named = index.normalize_tags(tags, files.read_aliases(spark, f"{folder}/aliases.txt"))
    return named.join(known, "tag", "left").select("doc_id", "tag", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT what, n, 2::BIGINT AS version, 'second' AS stamp FROM (SELECT unnest(['nodes', 'links', 'node_themes', 'meta']) AS what, unnest([count(*), 2 * count(*), count(source) + count(lang), 1]) AS n FROM documents)")
def index_rebuilt(spark, sf_dir):
    """An index replaced as a whole: what a reader sees after two rebuilds."""
    root = new_folder(spark, "index")
    rows = _nodes(spark, sf_dir)
    index.rebuild(root, rows.withColumn("themes", F.array()), "first")
    index.rebuild(root, rows, "second")
    now = snapshots.current(spark, root)
    parts = [snapshots.read(spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name in now.names]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("what", "n", F.lit(now.version).cast("long").alias("version"), F.lit(now.stamp).alias("stamp"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN NULL WHEN 3 THEN 'image/webp' ELSE 'image/gif' END AS media_type, CASE WHEN page_id % 5 = 2 THEN 'unsupported type' WHEN strlen(html) > 2000 THEN 'too large' END AS error FROM pages")
def image_checks(spark, sf_dir):
    """Files by suffix and size, as images are let in."""
    suffix = F.get(F.array(*map(F.lit, ("png", "JPG", "txt", "webp", "gif"))), F.col("page_id") % 5)
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(".", F.concat(F.lit("/in/"), "page_id"), suffix).alias("path"), F.octet_length("html").cast("long").alias("length"))
    return ingest.check_images(rows, most=2000).select("page_id", "media_type", "error")


@query("SELECT doc_id, doc_id % 5 = 3 AND doc_id % 3 <> 0 AS prefix_node, doc_id % 5 = 1 AND doc_id % 2 = 0 AS family_node FROM documents")
def node_roles(spark, sf_dir):
    """Which nodes stand for a prefix, and which for a family of words."""
    rows = _nodes(spark, sf_dir).select(F.col("seq").alias("doc_id"), "type", F.when(F.col("seq") % 3 != 0, F.col("seq") % 2 == 0).alias("separable"), F.when(F.col("seq") % 2 == 0, "root").otherwise("").alias("root"))
    return rows.select("doc_id", morph.is_prefix_node(F.col("type"), F.col("separable")).alias("prefix_node"), morph.is_family_node(F.col("type"), F.col("root")).alias("family_node"))
