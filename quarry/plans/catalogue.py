"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import corpus_queries, graph_queries, record_queries, search_queries, tool_queries

_PARTS = (corpus_queries, search_queries, graph_queries, record_queries, tool_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
