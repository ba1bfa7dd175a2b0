"""The catalogue of all queries of the corpus engine, and of the SQL that checks them."""

from __future__ import annotations

from loomwright.plans import corpus_queries, file_queries, job_queries, language_queries, proposal_queries, step_queries, text_queries  # noqa: F401  (they register)
from loomwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
