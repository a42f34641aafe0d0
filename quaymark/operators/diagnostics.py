"""Reports on labels, segments and flat runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions.columns import at

from .ranks import percentiles, same

CODES = {"short": 0, "timeout": 1, "long": 2, "ambiguous": -1, "invalid": -2, "closed": -3}


def label_counts(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of each label, and the percentages of the valid ones."""
    counts = {f"n_{k}": F.count_if(F.col("label") == v) for k, v in CODES.items()}
    valid = F.count_if(F.col("label").isin(0, 1, 2))
    pct = {f"{k}_pct": F.try_divide(100.0 * counts[f"n_{k}"], valid) for k in ("short", "timeout", "long")}
    return labels.groupBy(*by).agg(F.count("*").alias("n_rows"), valid.alias("n_valid"), *[v.alias(k) for k, v in (counts | pct).items()])


def with_year(rows: DataFrame) -> DataFrame:
    return rows.withColumn("year", F.year(at()))


def stability(yearly: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and minimum over the years."""
    return yearly.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min))])


def rollup(results: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    plain = results.groupBy(*by).agg(F.count("*").alias("n"), F.sum(column).alias("total"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    return same(plain, percentiles(results, column, {"median": 0.5}, by), by, "left" if by else "inner")


def segment_statistics(segments: DataFrame, least: int, by: Sequence[str] = ("instrument",)) -> DataFrame:
    plain = segments.groupBy(*by).agg(F.count("*").alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.count_if(F.col("length") >= least).alias("n_eligible"), F.sum(F.when(F.col("length") >= least, F.col("length")).otherwise(0)).alias("rows_eligible"))
    return same(plain, percentiles(segments, "length", {"median": 0.5}, by), by, "left" if by else "inner")


def run_histogram(runs: DataFrame, thresholds: Sequence[int], by: Sequence[str] = ("instrument",)) -> DataFrame:
    """Rows in runs of each length and more, and the number of such runs."""
    lengths = runs.groupBy(*by, "run").agg(F.max("run_length").alias("length"))
    cells = lengths.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("length >= threshold")
    return cells.groupBy(*by, "threshold").agg(F.count("*").alias("n_runs"), F.sum("length").alias("n_rows"))


def flat_summary(runs: DataFrame, closed_from: int) -> DataFrame:
    long = F.col("run_length") >= closed_from
    return with_year(runs).groupBy("year").agg(F.count("*").alias("n_rows"), F.count_if(long).alias("n_closed"), (100.0 * F.avg(long.cast("double"))).alias("closed_pct"), F.count_if(~long).alias("n_active"), F.count_if(F.col("run_length") >= 2).alias("n_flat2"))


def flat_and_still(runs: DataFrame, deviation: str, least: int) -> DataFrame:
    """Per year the rows in flat runs of this length and more, those whose deviation is 0, and those of both kinds."""
    flat, still = F.col("run_length") >= least, F.col(deviation) == 0
    return with_year(runs).groupBy("year").agg(F.count("*").alias("n_rows"), F.count_if(flat).alias("n_flat"), F.count_if(still).alias("n_still"), F.count_if(flat & still).alias("n_both"))


def reason_counts(rows: DataFrame) -> DataFrame:
    """Per year the rows of each reason."""
    return with_year(rows).groupBy("year", "reason").agg(F.count("*").alias("n"))
