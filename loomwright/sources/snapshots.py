"""Several tables replaced as one: each version has a folder of its own, one row appended last makes it current.

A reader takes the latest version that has such a row. While a rebuild runs, or after it has
failed, that is the old one, with all its tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources.files import exists

VERSIONS = "version long, folder string, stamp string, names array<string>"


def versions(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/versions"
    return spark.read.schema(VERSIONS).parquet(path) if exists(spark, path) else spark.createDataFrame([], VERSIONS)


def current(spark: SparkSession, root: str):
    """The row of the latest version; ``None`` if there is none."""
    return versions(spark, root).orderBy(F.desc("version"), F.desc("stamp"), "folder").first()


def publish(root: str, tables: dict[str, DataFrame], stamp: str) -> int:
    """Write the tables as a new version and make it current; the number of the version."""
    spark = next(iter(tables.values())).sparkSession
    last = current(spark, root)
    version = (last.version if last else 0) + 1
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    row = spark.createDataFrame([(version, folder, stamp, sorted(tables))], VERSIONS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the current version, or of an older one."""
    row = current(spark, root) if version is None else versions(spark, root).where(F.col("version") == version).first()
    if row is None or name not in row.names:
        raise LookupError(f"{root} has no {name}")
    return spark.read.parquet(f"{root}/{row.folder}/{name}")
