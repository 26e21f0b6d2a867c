"""Named queries: a DataFrame builder over the tables of a folder, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("corpus", "answers", "evaluation", "routing", "sft", "streams", "artifacts")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated builder as ``name``."""

    def add(build: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"lodecraft.plans.{name}")
