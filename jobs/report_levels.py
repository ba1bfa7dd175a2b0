"""Derives the level of every text by rules and word lists, and writes what to propose.

Whoever keeps a corpus for learners runs this over the whole corpus when rules or word lists
have changed. The source is a Parquet table with ``doc_id, text`` and, if it has them, ``title``,
``lemmas``, ``cefr`` and ``cefr_basis`` (else the first line is the title, and all words are
lemmas). Level changes are written to ``out/proposals`` as JSON lines in partitions by the new
level, and ``out/summary`` counts texts and changes by source and level as CSV. Both are
overwritten as a whole, so a run with the same input gives the same files' content, and levels
that nothing is proposed for any more lose their partition.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.operators import level
from loomwright.sources.files import read_wordlists

log = logging.getLogger("jobs.report_levels")
PROPOSAL = "proposal_id string, candidate string, source string, cefr_before string, cefr_basis string, cefr string"
SUMMARY = "source string, cefr string, texts long, changes long"


def nodes_of(docs: DataFrame) -> DataFrame:
    """Rows of the table as nodes; a null text counts as empty, rows without an id are left out."""
    has = lambda name, other: F.coalesce(F.col(name), other) if name in docs.columns else other
    text = F.coalesce("text", F.lit(""))
    words: Column = F.filter(F.split(F.lower(text), T.LINE_BREAK + r"|[ \t]"), lambda w: w != "")
    none = F.lit(None).cast("string")
    return docs.where("doc_id is not null").select(
        F.col("doc_id").cast("string").alias("id"),
        has("source", F.lit("")).alias("source"),
        has("title", F.substring_index(text, "\n", 1)).alias("title_de"),
        text.alias("body_md"),
        has("lemmas", words).alias("lemmas"),
        has("cefr", none).alias("cefr"),
        has("cefr_basis", none).alias("cefr_basis"),
    )


def run(spark: SparkSession, source: str, out: str, wordlists: str = "", rules: list | None = None, everything: bool = True, words: DataFrame | None = None) -> dict:
    """Derive all levels and write proposals and summary; ``rules`` are triples of name, level and pattern, by default the syllabus."""
    nodes = nodes_of(spark.read.parquet(source))
    words = level.word_levels(words if words is not None else read_wordlists(spark, wordlists))
    aim = nodes if everything else nodes.where(level.is_placeholder(F.col("cefr_basis")))
    derived = level.levels(aim, words, [level.Rule(*r) for r in rules] if rules else level.GRAMMAR, keep=("source",))
    # texts are read once; what follows needs levels only
    derived = written(derived, "levels")
    changed = F.col("derived").isNotNull() & ~(F.col("derived").eqNullSafe(F.col("cefr")) & F.col("derived_basis").eqNullSafe(F.col("cefr_basis")))
    proposals = derived.where(changed).select(
        T.proposal_id(F.lit("relevel"), F.col("id")).alias("proposal_id"), F.col("id").alias("candidate"), "source", F.col("cefr").alias("cefr_before"), F.col("derived_basis").alias("cefr_basis"), F.col("derived").alias("cefr")
    )
    proposals.repartition("cefr", F.pmod(F.xxhash64("candidate"), F.lit(max(1, derived.count() // 1_000_000)))).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("cefr").json(f"{out}/proposals")
    summary = derived.groupBy("source", F.coalesce("derived", "cefr", F.lit("-")).alias("cefr")).agg(F.count("*").alias("texts"), F.count_if(changed).alias("changes"))
    summary.write.mode("overwrite").option("header", True).csv(f"{out}/summary")
    done = {"texts": derived.count(), "proposals": read_proposals(spark, out).count()}
    log.info("read %d texts of %s, wrote %d proposals to %s", done["texts"], source, done["proposals"], out)
    return done


def read_proposals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PROPOSAL).json(f"{out}/proposals")


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SUMMARY).option("header", True).csv(f"{out}/summary")


if __name__ == "__main__":
    main("report_levels", run)
