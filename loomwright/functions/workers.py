"""Lets Python workers import this package where the driver does."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Add the package's folder to the workers' ``PYTHONPATH``.

    Workers on the driver's machine, or on machines with the same layout, then find it; on
    others it must be shipped or installed, and the extra entry does nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bounded_batches(spark: SparkSession) -> None:
    """Reach the workers, and let batches of texts that Spark sends them be small, however long the texts are."""
    reach_workers(spark)
    for key, most, usual in (("maxRecordsPerBatch", 1000, "10000"), ("maxBytesPerBatch", 4 << 20, str(1 << 30))):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name, usual))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
