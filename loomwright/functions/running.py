"""Running sums over groups of any size: no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, BEFORE = Window.unboundedPreceding, -1


def earlier(rows: DataFrame, keys: list[str], bucket: Column, order: list, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows before this one within ``keys``, by bucket, then ``order``.

    Two levels: the buckets of a group are summed and ordered, which is one row for each bucket;
    then rows within a bucket. Keys are not null, and ``bucket`` follows the order.
    """
    rows = rows.withColumn("_bucket", bucket)
    at = [*keys, "_bucket"]
    upper = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(FIRST, BEFORE)
    sums = rows.groupBy(*at).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*at, F.coalesce(F.sum("_sum").over(upper), F.lit(0)).alias("_upper"))
    within = Window.partitionBy(*at).orderBy(*order).rowsBetween(FIRST, BEFORE)
    before = F.col("_upper") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return rows.join(sums, at).withColumn("before", before).drop("_bucket", "_upper")
