"""Ingest from texts to staged candidates: identity, raw texts, the extraction step, ids, sidecars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.operators import ingest, models, steps


@dataclass
class Ingested:
    """What a run adds: raw texts and sidecars by source, staged nodes, and the sources that failed or were there already."""

    raw: DataFrame
    staged: DataFrame
    sidecars: DataFrame
    failed: DataFrame
    known: DataFrame


def ingest_texts(sources: DataFrame, client: models.Client, model: str, provider: str, stamp: str, now: Column, existing: DataFrame | None, taken: DataFrame, cache: DataFrame | None = None) -> Ingested:
    """Take ``sources(name, content)`` that ``existing(source_id, digest)`` lacks.

    A source's raw text is kept whether or not its extraction succeeds; a failed one has no
    sidecar, so the next run takes it again. The first candidates of a source count, up to the
    format's limit; none is no failure. Ids avoid ``taken(id)`` and each other; sources follow
    each other by the hash of their ids. Sidecars come last: they say that a source is done.
    """
    named = written(ingest.source_ids(sources, stamp, existing), "source_ids")
    # a source's first name is told without its text; a text is joined once, to the row that names it
    first = named.groupBy("source_id", "digest", "is_new").agg(F.min("name").alias("name"))
    texts = sources.select("name", "content", T.content_hash(F.col("content")).alias("digest"))
    first = first.join(texts, ["name", "digest"]).groupBy("name", "digest", "source_id", "is_new").agg(F.first("content").alias("text"))
    first = written(first.select("source_id", "digest", "is_new", F.col("name").alias("original_path"), "text", F.length("text").cast("long").alias("chars")), "sources")
    raw = first.where("is_new").select("source_id", "digest", "original_path", "text", "chars")
    done = written(steps.run(raw, steps.EXTRACT, F.col("text"), client, model, cache).drop("text"), "extracted")
    good = done.where("error is null")
    some = good.select("source_id", F.posexplode(F.slice("value.candidates", 1, ingest.MOST_CANDIDATES)).alias("at", "c"))
    # sources by hash, candidates in their order
    seq = F.expr("shiftleft(shiftright(xxhash64(source_id), 4), 4)") + F.col("at")
    some = written(some.select("source_id", seq.alias("seq"), "c.*"), "candidates")
    ids = ingest.node_ids(some, taken).select("seq", "node_id")
    nodes = ingest.to_nodes(some.join(ids, "seq"), now)
    staged = nodes.withColumn("source_id", F.col("source_ids")[0])
    counts = F.least(F.size("value.candidates"), F.lit(ingest.MOST_CANDIDATES))
    sidecars = good.select("source_id", "original_path", F.col("digest").alias("content_sha256"), now.alias("ingested_at"), "chars", F.lit(model).alias("model"), F.lit(provider).alias("provider"), counts.alias("candidate_count"))
    return Ingested(raw.select("source_id", "digest", "text"), staged, sidecars, done.where("error is not null").select("source_id", "error", "attempts"), first.where("not is_new").select("source_id", "original_path"))
