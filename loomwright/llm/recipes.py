"""Production parameters that queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target shares of tokens; "*" stands for all other values.
TARGETS: dict[str, dict[str, float]] = {
    "source": {f"src{k}": 0.05 for k in range(20)} | {"*": 0.02},
    "lang": {"en": 0.52, "de": 0.18, "fr": 0.17, "es": 0.13, "*": 0.02},
    "topic": {"prose": 0.56, "long": 0.32, "short": 0.05, "contact": 0.04, "legal": 0.03, "*": 0.01},
}


def topic(text: Column, tokens: Column, masked: bool = False) -> Column:
    """Topic of a document, by what it holds and how long it is.

    In a ``masked`` text the marks of addresses and phone numbers stand for what they replaced.
    """
    legal = F.contains(text, F.lit("License")) | F.contains(text, F.lit("Copyright")) | F.contains(text, F.lit("copyright"))
    contact = F.contains(text, F.lit("@")) | F.contains(text, F.lit("+1 ("))
    if masked:
        contact = contact | F.contains(text, F.lit("[EMAIL]")) | F.contains(text, F.lit("[PHONE]"))
    return F.when(legal, "legal").when(contact, "contact").when(tokens < 150, "short").when(tokens >= 1200, "long").otherwise("prose")
