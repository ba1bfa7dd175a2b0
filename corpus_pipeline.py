"""Corpus pipeline: the stages that turn ``documents`` into encoded training text.

Each stage works on all that the one before it kept; its result is written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import lang_id, mixing, neardup, pii, prefix_bpe, recipes
from loomwright.llm.shared import scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least score of a language that is accepted, and least share of a text's longest n-grams that
#: training saw in it: the score only compares the learned languages, so it alone accepts any text.
LEAST_SCORE, LEAST_KNOWN = 0.5, 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents without one (null or letterless text, a score under 0.5, or a text of which training knows less than 0.4) go."""
    model = lang_id.fit(docs, order_by=F.col("doc_id"))
    told = lang_id.identify(docs, model, keep=("doc_id", "text", "source", "n_chars"), known_out="known")
    sure = (F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE) & (F.col("known") >= LEAST_KNOWN)
    return told.where(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the least id."""
    return neardup.drop_copies(docs.select(*COLUMNS), width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; all documents stay, ``n_chars`` follows."""
    found = pii.find(docs.select(*COLUMNS))
    found = found.withColumn("text", pii.mask(F.col("text"), F.col("pii_spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of source, language and topic."""
    mixed = mixing.mix(docs.select(*COLUMNS), recipes.TARGETS, recipes.topic(F.col("text"), F.col("mix_tokens"), masked=True), mixing.n_tokens(F.col("text")))
    return mixed.where("mix_selected").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) of all documents, and their number."""
    ranks = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = prefix_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))
    faithful = F.octet_length("decoded").cast("long").alias("decoded_bytes")
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), faithful, "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the language model, the near-duplicate components nor BPE; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again, and what the stage left goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
