"""One small Spark session for all tests, and DuckDB beside it."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not DATA.is_dir():
        pytest.skip(f"no test tables in {DATA}")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value that both engines show alike: whole floats as integers, missing as ``None``."""
    if value is None or type(value).__name__ in ("NaTType", "NAType"):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, float):
        return None if math.isnan(value) else int(value) if value.is_integer() else value
    return value


def rows_of(frame, columns) -> list[str]:
    return sorted(repr([plain(x) for x in row]) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Runs a query and its SQL over the same tables and compares all rows."""
    def check(query, sql: str) -> int:
        got, want = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows_of(got, columns) == rows_of(want, columns)
        return len(got)

    return check
