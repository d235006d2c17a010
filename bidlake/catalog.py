"""All registered queries of the procurement operators, with the SQL they must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "A4_province_rollup"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under its operator's number, with its SQL counterpart where there is one."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


MODULES = ["operators.filters", "operators.joins", "operators.aggregates", "operators.ordering", "functions.scalars", "plans.views", "plans.domain", "plans.requirements", "plans.lifecycle", "plans.lexical", "plans.percolate", "plans.containment", "plans.cells", "sources.ingest", "streaming.incremental"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"bidlake.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
