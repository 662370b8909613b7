"""Collects the registered queries and composes their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import VIEWS, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query; ``sql`` may name the views of the catalog."""

    def add(make: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = make
        if sql is not None:
            _SQL[name] = _with_views(sql)
        return make

    return add


def _with_views(sql: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    if not views:
        return sql
    if re.match(r"with recursive\b", sql, re.I):
        return f"with recursive {views}, {sql[14:].lstrip()}"
    if re.match(r"with\b", sql, re.I):
        return f"with {views}, {sql[4:].lstrip()}"
    return f"with {views} {sql}"


def _load() -> None:
    from . import archive, audit, chunks, frames, inventory, logs, ops, placement, streams, tiers  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, make=make: make(Tables(spark, sf_dir))) for name, make in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
