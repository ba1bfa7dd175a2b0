"""What people read and where files lie: amounts, report lines, differences of bodies, paths of stored things."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.workers import bounded_batches


def money(x: Column) -> Column:
    """Dollars with six decimals, a dash where the price is not known."""
    return F.when(x.isNull(), F.lit("—")).otherwise(F.format_string("$%.6f", x.cast("double")))


def usage_lines(report: DataFrame) -> DataFrame:
    """``label, calls, hits, hit_rate, prompt, cached, completion, cost, saved`` as text, groups by name and the total last."""
    count = lambda c: F.format_string("%,d", F.col(c).cast("long"))
    label = F.when(F.col("is_total"), "total").otherwise(F.coalesce("name", F.lit("")))
    lines = report.select(
        label.alias("label"), F.col("calls").cast("string").alias("calls"), F.col("hits").cast("string").alias("hits"), F.concat(F.bround(F.col("hit_rate") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("hit_rate"),
        count("prompt_tokens").alias("prompt"), count("cached_prompt_tokens").alias("cached"), count("completion_tokens").alias("completion"), money(F.col("cost_usd")).alias("cost"), money(F.col("saved_usd")).alias("saved"), "is_total",
    )
    return lines.orderBy("is_total", "label").drop("is_total")


def body_diff(before: Column, after: Column, from_label: str = "before", to_label: str = "after") -> Column:
    """``array<string>``: the unified difference of two bodies, line by line; empty if nothing changed. Null counts as empty."""
    bounded_batches(SparkSession.active())

    @F.pandas_udf("array<string>")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), from_label, to_label, lineterm="")) for x, y in zip(a, b, strict=True)])

    return apply(before, after)


def raw_paths(source_id: Column, root: str) -> tuple[Column, Column]:
    """Paths of a source's text and of its sidecar."""
    return F.concat(F.lit(f"{root}/"), source_id, F.lit(".txt")), F.concat(F.lit(f"{root}/"), source_id, F.lit(".json"))


def artifact_path(source_id: Column, suffix: Column, root: str) -> Column:
    """Path of what a source was read from, beside its text; a suffix with or without its dot."""
    return F.concat(F.lit(f"{root}/"), source_id, F.lit("."), F.regexp_replace(F.lower(suffix), r"^\.", ""))


def cache_path(key: Column, root: str, model: str | None = None) -> Column:
    """Path of a cache entry: by the first two characters of its key, vectors by their model before that."""
    below = "" if model is None else f"{re.sub(r'[^a-z0-9]+', '-', model.lower()).strip('-') or 'model'}/"
    return F.concat(F.lit(f"{root}/{below}"), F.substring(key, 1, 2), F.lit("/"), key, F.lit(".json"))


def proposal_path(proposal_id: Column, root: str) -> Column:
    return F.concat(F.lit(f"{root}/"), proposal_id, F.lit(".md"))
