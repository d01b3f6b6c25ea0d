"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB twin (None = rows-only check)."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import catalog, catalog_explain, catalog_models, catalog_quality, catalog_reports  # noqa: F401
    return QUERIES, ORACLE
