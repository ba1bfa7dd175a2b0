"""Streams: a folder watched for new sources, appended once each by the hash of their content.

The write-once rule of batches, for files that keep coming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.index import write_once


def append_new(batch: DataFrame, target: str) -> None:
    """Append rows of ``batch(path, text)`` whose content ``target`` lacks."""
    spark = batch.sparkSession
    rows = batch.select(T.content_hash(F.col("text")).alias("digest"), "path", "text")
    try:
        old = spark.read.parquet(target).select("digest")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = rows.select("digest").limit(0)
    write_once(old, rows, "digest").write.mode("append").parquet(target)


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """A query over new text files of a folder; a batch that runs again appends nothing twice."""
    stream = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_day(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls and cost of each day and step of a stream of usage rows with ``time``; late rows count up to ``delay``."""
    day = F.window("time", "1 day").alias("day")
    return events.withWatermark("time", delay).groupBy(day, "step").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))
