"""Registered queries of the bar engine and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.plans import bar_queries, stream_queries, study_queries  # noqa: F401  (the others register their queries with the first)


def _all() -> list[tuple[str, Callable, str | None]]:
    return bar_queries.FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f, _ in _all()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _all() if sql is not None}
