"""Bars that the registered queries run on, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.tables import DAY, HOUR, MINUTE, event_bars, line_bars, order_bars


def minute_bars(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(spark, d, MINUTE)


def hour_bars(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(spark, d, HOUR)


def hour_bars_by_type(spark: SparkSession, d: str) -> DataFrame:
    return event_bars(spark, d, HOUR, by_type=True)


def coarse_hour_bars(spark: SparkSession, d: str) -> DataFrame:
    """Closes in steps of 25, so that flat runs occur."""
    return hour_bars(spark, d).withColumn("close", F.floor(F.col("close") / 25.0) * 25.0)


def day_bars(spark: SparkSession, d: str) -> DataFrame:
    return line_bars(spark, d)


def order_day_bars(spark: SparkSession, d: str) -> DataFrame:
    return order_bars(spark, d)


def _events(step: int, instrument: str = "'events'") -> str:
    return f"""SELECT {instrument} AS instrument, epoch_ms(ts) // {step} * {step} AS ts_ms, arg_min(value, (ts, event_id)) AS "open", max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS "close" FROM events GROUP BY 1, 2"""


_LINE_KEY = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
SQL = {
    "m1": _events(MINUTE),
    "h1": _events(HOUR),
    "ht": _events(HOUR, "event_type"),
    "hq": f"""SELECT instrument, ts_ms, "open", high, low, floor("close" / 25.0::DOUBLE) * 25.0::DOUBLE AS "close" FROM ({_events(HOUR)})""",
    "d1": f"""SELECT 'lines' AS instrument, epoch_ms(l_shipdate) // {DAY} * {DAY} AS ts_ms, arg_min(v, {_LINE_KEY}) AS "open", max(v) AS high, min(v) AS low, arg_max(v, {_LINE_KEY}) AS "close"
        FROM (SELECT *, l_extendedprice / l_quantity AS v FROM lineitem) GROUP BY 1, 2""",
    "o1": f"""SELECT 'orders' AS instrument, epoch_ms(o_orderdate) // {DAY} * {DAY} AS ts_ms, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS "open", max(o_totalprice) AS high,
        min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS "close" FROM orders GROUP BY 1, 2""",
}


def with_bars(name: str, query: str, *more: str) -> str:
    """WITH b AS (the bars), more... query."""
    return "WITH " + ", ".join([f"b AS ({SQL[name]})", *more]) + " " + query


def segments(step: int, source: str = "b", name: str = "s") -> str:
    """CTE: source with segment (from 1)."""
    return f"""{name} AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY instrument ORDER BY ts_ms) AS segment FROM
        (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY instrument ORDER BY ts_ms) = {step} THEN 0 ELSE 1 END AS fresh FROM {source}))"""
