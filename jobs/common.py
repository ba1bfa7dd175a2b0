"""What the jobs share: their command line, their log, and a session for it."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(name: str, run: Callable[..., dict], argv: list[str] | None = None) -> dict:
    """``python -m jobs.<name> [--config FILE] [--<setting> VALUE ...]``: settings on the line stand over the file's."""
    config = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    parser = argparse.ArgumentParser(prog=f"jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", help="a file of settings; by default the one beside the job")
    for key, value in config.items():
        parser.add_argument(f"--{key.replace('_', '-')}", type=json.loads if isinstance(value, (list, dict)) else type(value))
    given = vars(parser.parse_args(argv))
    if path := given.pop("config"):
        config |= json.loads(Path(path).read_text())
    config |= {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        return run(spark, **config)
    finally:
        spark.stop()
