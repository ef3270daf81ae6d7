"""The list of queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}

MODULES = ("sources", "cleaning", "transforms", "joins", "aggregates", "metrics", "leaderboard", "splits", "labelling", "graphs", "fitted", "thresholds", "functions")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` runs in DuckDB on the same tables."""

    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} registered twice")
        _queries[name] = fn
        if sql is not None:
            _oracle[name] = sql
        return fn

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"cellgauge.catalog.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
