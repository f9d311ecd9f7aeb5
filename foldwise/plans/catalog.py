"""The full catalogue: importing the query modules fills the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldwise.plans import (  # noqa: F401
    evaluation_queries,
    file_queries,
    metric_queries,
    model_queries,
    repair_queries,
    report_queries,
    similarity_queries,
    split_queries,
    summary_queries,
)
from foldwise.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
