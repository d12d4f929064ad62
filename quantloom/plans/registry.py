"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quantloom.sources.domain import Tables

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the tables as a query, with the SQL that gives the same rows; a name can be given once."""
    def add(function: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"a query named {name} is registered already")
        _QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return function
    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for the SQL of one that keeps its rows elsewhere."""
    return _SQL[name]


def queries() -> dict:
    from quantloom.plans import backtest, crosssection, exports, ingest, lookups, market, portfolio, reports, runs, score, screening, shown, statements, weights  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
