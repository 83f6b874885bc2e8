"""All queries on the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ["functions", "impacts", "change_risk", "verifying", "relational", "windows", "evaluation", "studies", "texts", "retrieving", "graphs", "campus", "code", "events"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql: what DuckDB runs to check it."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"riskloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
