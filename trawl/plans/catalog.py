"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawl.plans import change_queries, event_queries, golden_queries, report_queries, search_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [search_queries, report_queries, event_queries, change_queries, golden_queries]


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


FLAGSHIP: Query = search_queries.QUERIES["search_phrase"]
