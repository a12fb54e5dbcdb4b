"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import Inputs, duckdb_with
from pulseweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHECK_SECONDS = 600.0


def register(name: str, run: Callable[[Inputs], DataFrame], views: list[str], sql: str) -> None:
    """``run`` builds the query from the views; ``sql`` is its DuckDB counterpart."""

    def call(spark: SparkSession, directory: str) -> DataFrame:
        return run(Inputs(configure(spark), directory))

    QUERIES[name] = call
    ORACLES[name] = duckdb_with(views, sql)
