"""Canonical JSON and the cache keys made from it (an Arrow UDF: ``to_json`` drops nulls and escapes otherwise)."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, text unescaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def cache_key(material: Column) -> Column:
    """sha256 of the canonical form of a JSON text."""
    @F.pandas_udf("string")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else hashlib.sha256(canonical_json(json.loads(s)).encode()).hexdigest())

    return apply(material)
