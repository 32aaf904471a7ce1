"""Registered queries: one per operator, each with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.plans.views import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may refer to ``views``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return fn

    return register


def r6(x, digits: int = 6) -> Column:
    """Rounded, without a negative zero. More digits where six would fall on exact ties."""
    return F.round(x if isinstance(x, Column) else F.col(x), digits) + 0.0


def q6(expr: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"round({expr}, {digits}) + 0e0"


def joined(a: Column) -> Column:
    """An integer array as comma-separated text."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
