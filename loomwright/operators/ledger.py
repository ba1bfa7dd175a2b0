"""Usage and decision ledgers: totals, costs, regeneration counts, decided pairs, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.joins import grown

TOKENS = ("prompt_tokens", "cached_prompt_tokens", "completion_tokens", "total_tokens")
REGENERATING = "OVERLAP"
MOST_REGENERATIONS = 5
# The order of kinds in a review.
KIND_ORDER = ("create", "merge", "link", "relevel", "morphology", "discard")


def cost(prompt: Column, cached: Column, completion: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    """Dollars of a call, rates for a million tokens; null without a rate, the full rate where there is none for cached input."""
    fresh = F.greatest(prompt - cached, F.lit(0))
    return (fresh * rate_in + cached * F.coalesce(rate_cached, rate_in) + completion * rate_out) / 1_000_000


def measures() -> list[Column]:
    calls, hits = F.count("*"), F.sum(F.when(F.col("cached"), 1).otherwise(0))
    return [
        calls.alias("calls"),
        hits.alias("hits"),
        (hits / calls).alias("hit_rate"),
        *(F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in TOKENS),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.sum(F.coalesce("saved_usd", F.lit(0.0))).alias("saved_usd"),
        F.sum(F.when(F.col("cost_usd").isNull(), 1).otherwise(0)).alias("unpriced_calls"),
    ]


def day(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def since(usage: DataFrame, first_day: str) -> DataFrame:
    """Calls of a day or later; days compare as text."""
    return usage.where(day(F.col("ts")) >= first_day)


def usage_totals(usage: DataFrame, by: str | None = None) -> DataFrame:
    """One row of totals, or one a group of ``step``, ``model``, ``provider`` or ``day`` (as ``name``)."""
    if by is None:
        return usage.agg(*measures())
    key = day(F.col("ts")) if by == "day" else F.col(by)
    return usage.groupBy(key.alias("name")).agg(*measures())


def usage_report(usage: DataFrame, by: str) -> DataFrame:
    """Groups and the grand total (null name, ``is_total``) in one pass."""
    key = day(F.col("ts")) if by == "day" else F.col(by)
    rows = usage.withColumn("name", key)
    return rows.rollup("name").agg((F.grouping("name") == 1).alias("is_total"), *measures())


def merge_counts(decisions: DataFrame) -> DataFrame:
    """Approved regenerations of each winner."""
    return decisions.where(F.col("approved") & (F.col("outcome") == REGENERATING)).groupBy("winner").agg(F.count("*").alias("n_merges"))


def decided_pairs(decisions: DataFrame) -> DataFrame:
    """Pairs that any merge decision has named, approved or not; rows without both sides do not count."""
    both = decisions.where("winner is not null and loser is not null")
    return both.select(F.least("winner", "loser").alias("left_id"), F.greatest("winner", "loser").alias("right_id")).distinct()


def check_cap(nodes: DataFrame, decisions: DataFrame | None, limit: int = MOST_REGENERATIONS) -> DataFrame:
    """``id, n_merges, allowed``. Without a readable ledger (``None``) only nodes never written before may be merged."""
    if decisions is None:
        return nodes.select("id", F.lit(None).cast("long").alias("n_merges"), (F.coalesce("version", F.lit(1)) <= 1).alias("allowed"))
    counted = nodes.select("id").join(grown(merge_counts(decisions).withColumnRenamed("winner", "id")), "id", "left").withColumn("n_merges", F.coalesce("n_merges", F.lit(0)))
    return counted.select("id", "n_merges", (F.col("n_merges") < limit).alias("allowed"))


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KIND_ORDER)), kind).cast("int") - 1


def review_order(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy(kind_rank(F.col("kind")), F.desc(F.coalesce("similarity", F.lit(0.0))), "id")
