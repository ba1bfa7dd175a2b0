"""Vectors of nodes: cached ones first, an injected embedder for the rest, stored by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.operators.index import checked_vectors, upsert

#: A function from texts to vectors; it runs in Arrow batches on what the cache lacks.
Embedder = Callable[[list[str]], list[list[float]]]


def dedup_text(title_de: Column, title_en: Column, body: Column) -> Column:
    """What the first two tiers of duplicates compare: both titles and the body, as lines."""
    return F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in (title_de, title_en, body)))


def vector_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(model), text), 256)


def vectors_for(nodes: DataFrame, model: str, cache: DataFrame, embedder: Embedder | None, width: int) -> DataFrame:
    """``node_id, key, embedding, computed`` of ``nodes(id, title_de, body_md)``.

    ``cache(key, embedding)`` answers first; an entry of another width is a miss. Each text is
    embedded once, whatever the number of nodes that have it. Without an embedder only what the
    cache holds is returned. Vectors of another width than ``width`` fail.
    """
    text = T.embed_text(F.col("title_de"), F.col("body_md"))
    asked = nodes.select(F.col("id").alias("node_id"), text.alias("text"))
    # texts are made, and the cache is read, once
    asked = written(asked.withColumn("key", vector_key(model, F.col("text"))), "asked")
    good = cache.where(F.size("embedding") == width).groupBy("key").agg(F.first("embedding").alias("embedding"))
    found = written(asked.select("node_id", "key").join(good, "key", "left"), "found")
    held = found.where("embedding is not null").select("node_id", "key", "embedding", F.lit(False).alias("computed"))
    if embedder is None:
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "embedding"])

    missing = found.where("embedding is null").select("node_id", "key")
    fresh = asked.join(missing.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).mapInArrow(run, "key string, embedding array<float>")
    new = missing.join(fresh, "key").select("node_id", "key", "embedding", F.lit(True).alias("computed"))
    return held.unionByName(checked_vectors(new, width))


def store_vectors(stored: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored vectors after the new ones: one a node, the new one."""
    return upsert(stored.select("node_id", "embedding"), vectors.select("node_id", "embedding"), "node_id")


def stored_ids(stored: DataFrame) -> DataFrame:
    """Ids that have a vector."""
    return stored.select("node_id").distinct()


def indexed(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that have both a node and a vector."""
    return nodes.select("id").join(stored.select(F.col("node_id").alias("id")), "id", "left_semi")


def set_meta(meta: DataFrame, key: str, value: Column) -> DataFrame:
    """The table ``key, value`` after one key is set."""
    return upsert(meta.select("key", "value"), meta.sparkSession.range(1).select(F.lit(key).alias("key"), value.cast("string").alias("value")), "key")


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("value")


def cache_after(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Cache entries after a write; a new entry replaces one of its key."""
    return upsert(entries, new, "key")


def cache_clear(entries: DataFrame, older_than: Column | None = None) -> DataFrame:
    """What is left of a cache that is cleared, or cleared of entries last written before a time."""
    return entries.limit(0) if older_than is None else entries.where(F.col("modified") >= older_than)
