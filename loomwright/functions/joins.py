"""Joins of tables that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that has a row for each pair, node or candidate: it never goes whole through the driver.

    Spark guesses a table's size from its files, which are compressed, and lack what is made of
    their columns; so it would broadcast tables many times larger than its limit.
    """
    return df.hint("merge")
