"""Names, callables and check SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def with_ctes(ctes: tuple[str, ...], sql: str) -> str:
    """A leading comma in ``sql`` continues the list of common table expressions."""
    if not ctes:
        return sql
    return f"WITH {', '.join(ctes)}" + ("" if sql.startswith(",") else "\n") + sql


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; ``ctes`` are adapter expressions put before ``sql``."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = with_ctes(ctes, sql.strip())
        return function

    return add
