"""The registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import activity, catalog_queries, lifecycle, offline, ordered_queries, serving, tables

#: The query that `entry` runs.
FLAGSHIP = "item_stats"
_ALL = activity.QUERIES | catalog_queries.QUERIES | lifecycle.QUERIES | offline.QUERIES | ordered_queries.QUERIES | serving.QUERIES | tables.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
