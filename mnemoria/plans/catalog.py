"""All queries of the library and their oracles."""

from __future__ import annotations

from . import annotation, knowledge, measures, reflection, retrieval, rules, store  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
