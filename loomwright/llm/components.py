"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.shared import written


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over directed edges ``u > v``.

    The least neighbour comes from a partial aggregation and a join, so a node with very many
    edges is summed before the shuffle and its join may be split; nothing gathers its edges.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # every node already points below itself here, so small-star links what one node points to
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node.

    Nulls and self-links are ignored; repeated edges count once; no edges give no rows. Each
    round is written to the shared folder, and two sums tell when nothing moves any more, so
    no edges reach the driver. More than ``max_rounds`` rounds raise an error.
    """
    a, b = F.col(left), F.col(right)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")
    before = None
    for k in range(max_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(sums) == before:
            top = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)
        before = tuple(sums)
        if not before[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = written(_round(now), f"round{k}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
