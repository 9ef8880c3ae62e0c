"""Registry of named queries and the SQL that states the same result for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: memories as the oracle sees them.
MEM = "memories AS (SELECT doc_id AS id, text AS content, lang AS wing, source AS room, 1704067200 + doc_id * 3600 AS created_at FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql None: it is checked by row counts and tests only."""

    def put(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put
