"""The derived index: node, link and theme tables, listing, staleness, upserts, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.sources import snapshots


def normalize_tags(tags: DataFrame, aliases: DataFrame, tag_col: str = "tag") -> DataFrame:
    """``tag`` folded and mapped through ``aliases(alias, canonical)``; empty tags go."""
    folded = tags.withColumn(tag_col, T.norm_tag(F.col(tag_col))).where(F.col(tag_col) != "")
    mapped = folded.join(aliases.select(T.norm_tag(F.col("alias")).alias(tag_col), "canonical"), tag_col, "left")
    return mapped.withColumn(tag_col, F.coalesce("canonical", tag_col)).drop("canonical")


def reindex(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, links, node_themes)``: one row a node, one a link, one a theme."""
    links = nodes.select(F.col("id").alias("source_id"), F.explode("links").alias("l")).select("source_id", "l.target", "l.relation", "l.confidence")
    themes = nodes.select(F.col("id").alias("node_id"), F.explode("themes").alias("theme"))
    return nodes, links, themes


def rebuild(root: str, nodes: DataFrame, stamp: str) -> int:
    """Replace the index in ``root`` as a whole: its three tables and the stamp change together or not at all."""
    nodes, links, themes = reindex(nodes)
    meta = nodes.sparkSession.range(1).select(F.lit("indexed_at").alias("key"), F.lit(stamp).alias("value"))
    return snapshots.publish(root, {"nodes": nodes, "links": links, "node_themes": themes, "meta": meta}, stamp)


def index_counts(nodes: DataFrame, links: DataFrame, themes: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("nodes", nodes), ("links", links), ("themes", themes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def list_nodes(nodes: DataFrame, themes: DataFrame | None = None, level: str | None = None, type_: str | None = None, theme: str | None = None) -> DataFrame:
    """Nodes by level, type and theme, by id. A theme that a node has twice lists it twice."""
    if theme is not None:
        nodes = nodes.join(themes.where(F.col("theme") == theme).select(F.col("node_id").alias("id")), "id")
    if level is not None:
        nodes = nodes.where(F.col("cefr") == level)
    if type_ is not None:
        nodes = nodes.where(F.col("type") == type_)
    return nodes.orderBy("id")


def is_stale(files: DataFrame, stamp: Column) -> DataFrame:
    """One row ``stale``: a file is newer than the stamp, or there is no stamp."""
    return files.agg((stamp.isNull() | F.coalesce(F.max("modified") > stamp, F.lit(False))).alias("stale"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def checked_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """Fails on a vector of another width."""
    return vectors.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"vector width is not {width}: "), F.col("node_id")))))


def write_once(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What may be appended: rows whose key is not there yet, the least row of each key."""
    rest = [c for c in new.columns if c != key]
    first = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return first.select(key, "_row.*")


def cache_split(asked: DataFrame, cache: DataFrame, key: str, value: str, valid: Column) -> DataFrame:
    """``asked`` with the cached value and ``hit``; an entry that is not ``valid`` is a miss."""
    good = cache.where(F.coalesce(valid, F.lit(False))).select(key, value).dropDuplicates([key])
    return asked.join(good, key, "left").withColumn("hit", F.col(value).isNotNull())


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"))


def queue_rows(queue: DataFrame) -> DataFrame:
    """``source_id, id, pending``: every pending row beside its source's number of them, in order; for queues of any size."""
    counts = queue.groupBy("source_id").agg(F.count("*").alias("pending"))
    return queue.select("source_id", "id").join(counts, "source_id").orderBy("source_id", "id")


def queue_listing(queue: DataFrame) -> DataFrame:
    """Pending rows of each source with their ids in one line, as people read them; see :func:`queue_rows` for sources with very many."""
    return queue.groupBy("source_id").agg(F.count("*").alias("pending"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
