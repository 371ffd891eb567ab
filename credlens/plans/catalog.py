"""Registry of named queries: one Spark callable (spark, sf_dir) -> DataFrame
and, where the result is SQL-expressible, one DuckDB oracle string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


MODULES = ("q_prepare", "q_enrich", "q_language", "q_store", "q_features", "q_models", "q_stream")
