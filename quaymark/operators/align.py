"""Several series on exact times: joins, coverage and re-verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combined(a: DataFrame, b: DataFrame, suffix: str = "_usd", on: str = "ts_ms") -> DataFrame:
    """Inner join on the time; columns of b that a has too get the suffix."""
    return a.join(b.select(on, *[F.col(c).alias(c + suffix if c in a.columns else c) for c in b.columns if c != on]), on)


def one_to_one(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join; raises at the next action if b has a key twice. Without a match b's columns are NULL."""
    once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("duplicate key")).cast("boolean"))
    unique = b.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in b.columns if c not in on]).where(once).drop("_n")
    return a.join(unique, list(on), "left")


def coverage(a: DataFrame, b: DataFrame, on: str = "ts_ms") -> DataFrame:
    """Per year of a: rows, rows whose time b has, and their percentage."""
    flagged = a.join(b.select(on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    year = F.year(F.timestamp_millis(F.col(on)))
    return flagged.groupBy(year.alias("year")).agg(F.count("*").alias("n_rows"), F.count("_hit").alias("n_matched"), (100.0 * F.count("_hit") / F.count("*")).alias("matched_pct"))


def looked_up(keys: DataFrame, values: DataFrame, on: Sequence[str], strict: bool = True) -> DataFrame:
    """Rows of keys with the values of the same key. strict: a key without values raises; else it is dropped."""
    if not strict:
        return keys.join(values, list(on))
    found = keys.join(values.withColumn("_hit", F.lit(True)), list(on), "left")
    return found.where(F.when(F.col("_hit"), True).otherwise(F.raise_error(F.lit("key without values")).cast("boolean"))).drop("_hit")


def by_position(rows: DataFrame, target: str, columns: Sequence[str], prefix: str = "exit_") -> DataFrame:
    """rows have position; adds columns of the row at position target, NULL without one."""
    there = rows.select("instrument", F.col("position").alias(target), *[F.col(c).alias(prefix + c) for c in columns])
    return rows.join(there, ["instrument", target], "left")


def alignment(features: DataFrame, labels: DataFrame, on: Sequence[str], label: str = "label") -> DataFrame:
    """One row: feature rows, those with and without a label row, and label counts."""
    found = features.select(*on).join(labels.select(*on, F.col(label).alias("_l")).withColumn("_hit", F.lit(1)), list(on), "left")
    codes = {"short": 0, "timeout": 1, "long": 2, "ambiguous": -1, "invalid": -2, "closed": -3}
    return found.agg(F.count("*").alias("n_rows"), F.count("_hit").alias("n_matched"), (F.count("*") - F.count("_hit")).alias("n_missing"), *[F.count_if(F.col("_l") == k).alias(f"n_{n}") for n, k in codes.items()])


def reverified(derived: DataFrame, official: DataFrame, on: Sequence[str], column: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: compared, mismatching and missing values of a column, and the largest difference."""
    both = derived.select(*on, F.col(column).alias("_a")).join(official.select(*on, F.col(column).alias("_b"), F.lit(1).alias("_hit")), list(on), "left")
    off = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count("_hit").alias("n_compared"), F.count_if(F.col("_hit").isNull()).alias("n_missing"), F.count_if((off > tolerance) | (F.col("_a").isNull() != F.col("_b").isNull()) & F.col("_hit").isNotNull()).alias("n_mismatched"), F.max(off).alias("max_difference"))


def forward_by_time(bars: DataFrame, step_ms: int, horizon: int) -> DataFrame:
    """The return to the bar exactly horizon steps later, by a self-join on the time instead of a window; bars without one drop out."""
    later = bars.select("instrument", (F.col("ts_ms") - horizon * step_ms).alias("ts_ms"), F.col("close").alias("_later"))
    return bars.join(later, ["instrument", "ts_ms"]).select("instrument", "ts_ms", (F.try_divide("_later", "close") - 1).alias(f"future_return_{horizon}m"))


def as_of(left: DataFrame, right: DataFrame, columns: Sequence[str], within_ms: int) -> DataFrame:
    """An extension: the last right row at or before each left time, no older than within_ms.

    Both sides are put in one order within time buckets of within_ms, each bucket with the right rows of the one before, and the last right row is carried
    forward: the work grows with the rows of a bucket, however dense it is."""
    bucket = F.floor(F.col("ts_ms") / within_ms)
    cell = F.struct(F.col("ts_ms").alias("r_ms"), *[F.col(c).alias(f"r_{c}") for c in columns])
    r = right.select("instrument", "ts_ms", F.explode(F.array(bucket, bucket + 1)).alias("_bucket"), F.lit(0).alias("_side"), cell.alias("_r"))
    rows = left.select("instrument", "ts_ms", bucket.alias("_bucket"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row")).unionByName(r, allowMissingColumns=True)
    upto = Window.partitionBy("instrument", "_bucket").orderBy("ts_ms", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("_found", F.last("_r", ignorenulls=True).over(upto)).where("_side = 1")
    found = F.when(F.col("_found.r_ms") > F.col("ts_ms") - within_ms, F.col("_found"))
    return carried.select("_row.*", found.alias("_found")).select(*left.columns, "_found.*")
