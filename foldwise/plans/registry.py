"""Named queries over the shared tables, each next to its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwise.functions.scalars import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
UNROUNDED: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query.  Doubles are rounded to six digits on both sides."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder))
        if sql is not None:
            UNROUNDED[name] = sql
            replaced = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS result" if replaced else sql
        return fn

    return register
