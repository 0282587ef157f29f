"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views_sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("catalogue", "text", "evidence", "graph", "sampling", "energy", "campaign", "quality",
            "hull")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function as query ``name``; ``views`` are the SQL views the twin selects from."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = views_sql.with_views(views, sql)
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
