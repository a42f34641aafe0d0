"""Walk-forward folds: expanding training, embargo, warm-up, purging, strides and nested selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import same
from .segments import BUCKET_BARS, number_starts, with_bucket

MINUTE = 60_000


def year_start(year: Column) -> Column:
    return F.unix_millis(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def folds(spark, years: Sequence[int], first_year: int, embargo_minutes: int = 61, warm_up_minutes: int = 480) -> DataFrame:
    """One row for each validation year: training [train_start, train_end], validation [valid_start, valid_end)."""
    y = F.col("fold")
    return spark.createDataFrame([(int(k),) for k in years], "fold int").select(
        "fold", year_start(F.lit(first_year)).alias("train_start"), (year_start(y) - embargo_minutes * MINUTE).alias("train_end"), (year_start(y) + warm_up_minutes * MINUTE).alias("valid_start"), year_start(y + 1).alias("valid_end")
    )


def in_folds(rows: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Rows with fold and part (train or valid): each row once for every fold that it is in. The folds are few and broadcast."""
    train = (F.col("ts_ms") >= F.col("train_start")) & (F.col("ts_ms") <= F.col("train_end"))
    valid = (F.col("ts_ms") >= F.col("valid_start")) & (F.col("ts_ms") < F.col("valid_end"))
    part = F.when(train, "train").when(valid, "valid")
    return rows.join(F.broadcast(fold_table), train | valid).withColumn("part", part).drop("train_start", "train_end", "valid_end")


def purged(parts: DataFrame, label_end: Column | None = None, minutes: int | None = None) -> DataFrame:
    """Training rows go whose label ends at the validation's start or later (label_end), or that lie within so many minutes before it."""
    keep = F.lit(True)
    if label_end is not None:
        keep = F.coalesce(label_end < F.col("valid_start"), F.lit(False))
    elif minutes is not None:
        keep = F.col("ts_ms") < F.col("valid_start") - minutes * MINUTE
    return parts.where((F.col("part") == "valid") | keep)


def strided(rows: DataFrame, k: int, where: Column | None = None, filter_first: bool = True, by: Sequence[str] = ("instrument",), span_ms: int = BUCKET_BARS * MINUTE) -> DataFrame:
    """Every k-th row in time, numbered after the filter or before it. Rows are numbered in time spans, whose counts are summed up in order."""
    if where is not None and filter_first:
        rows = rows.where(where)
    numbered = number_starts(with_bucket(rows, span_ms), F.lit(True), "_n", by).where((F.col("_n") - 1) % k == 0).select(*rows.columns)
    return numbered.where(where) if where is not None and not filter_first else numbered


def hash_sample(rows: DataFrame, share: float, seed: int = 42, key: str = "ts_ms") -> DataFrame:
    """A random sample without replacement that depends on the keys alone, not on the partitioning."""
    return rows.where(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))


def _draw(keys: Sequence[str], seed: int) -> Column:
    """The number that a row draws: the smallest are sampled. It depends on the keys alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def quotas(rows: DataFrame, total: int, by: Sequence[str]) -> DataFrame:
    """Of each part its share of `total` rows, in proportion to its size: whole shares first, what is left goes to the largest remainders (ties: in order of the part).
    No part gets more rows than it has."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    everything = Window.partitionBy(F.lit(0))
    exact = F.least(F.lit(total), F.sum("_size").over(everything)) * F.col("_size")
    parts = sizes.withColumns({"_whole": F.floor(exact / F.sum("_size").over(everything)).cast("long"), "_rest": exact % F.sum("_size").over(everything)})
    left = F.least(F.lit(total), F.sum("_size").over(everything)) - F.sum("_whole").over(everything)
    parts = parts.withColumns({"_left": left, "_place": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), *by))})
    return parts.select(*by, (F.col("_whole") + (F.col("_place") <= F.col("_left")).cast("int")).alias("quota"))


def exact_sample(rows: DataFrame, k: int | DataFrame, keys: Sequence[str] = ("instrument", "ts_ms"), seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """A random sample without replacement of just k rows, or of each part as many as its row of a table of quotas says (all, if it has fewer).

    Rows draw digests of their keys, and the smallest are taken: they are counted by their first 16 bits, and only those of the one count that the threshold falls into are put in
    order. The sample doesn't depend on the partitioning; keys must be unique.
    """
    drawn = rows.withColumn("_d", _draw(keys, seed)).withColumn("_b", F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"))
    counts = drawn.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto)
    wanted = same(counts, k, by) if isinstance(k, DataFrame) else counts.withColumn("quota", F.lit(k))
    # what is still to be taken from a count: all of it, some, or nothing
    take = wanted.withColumn("_take", F.least("_n", F.col("quota") - F.col("_upto") + F.col("_n"))).where("_take > 0").select(*by, "_b", "_n", "_take")
    some = same(drawn, take, [*by, "_b"])
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_d", *keys))
    edge = some.where("_take < _n").withColumn("_p", place).where("_p <= _take").select(*rows.columns)
    return some.where("_take = _n").select(*rows.columns).unionByName(edge)


def split_counts(rows: DataFrame, train_end: int, valid_end: int, test_end: int) -> DataFrame:
    t = F.col("ts_ms")
    return rows.agg(F.count_if(t < train_end).alias("n_train"), F.count_if((t >= train_end) & (t < valid_end)).alias("n_valid"), F.count_if((t >= valid_end) & (t < test_end)).alias("n_test"), F.count_if(t >= test_end).alias("n_outside"))


def selected(grid: DataFrame, by: Sequence[str], order: Sequence[Column], eligible: Column | None = None) -> DataFrame:
    """The best row of each group in the order given, of those that are eligible."""
    rows = grid if eligible is None else grid.where(eligible)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def nested(inner: DataFrame, outer: DataFrame, by: Sequence[str], choices: Sequence[str], order: Sequence[Column], eligible: Column) -> DataFrame:
    """Choices that are best on the inner results of each group, with the outer results of the same choices."""
    best = selected(inner, by, order, eligible).select(*by, *choices)
    return outer.join(best, [*by, *choices])


def enough_trades(grid: DataFrame, unfiltered: DataFrame, by: Sequence[str], least_share: float = 0.01, trades: str = "trades") -> DataFrame:
    """The rows of the grid that have this share, at least, of the trades of the unfiltered row of the same group."""
    most = unfiltered.select(*by, F.col(trades).alias("_all"))
    return grid.join(most, list(by)).where(F.col(trades) >= least_share * F.col("_all")).drop("_all")


def selected_or_fallback(grid: DataFrame, by: Sequence[str], order: Sequence[Column], eligible: Column, value: str, fallback: float) -> DataFrame:
    """selected(), and in groups without an eligible row the row nearest to the fallback value; chosen tells which."""
    best = selected(grid, by, order, eligible).withColumn("chosen", F.lit("best"))
    rest = nearest(grid, by, value, fallback).join(best.select(*by), list(by), "left_anti").withColumn("chosen", F.lit("fallback"))
    return best.unionByName(rest)


def nearest(grid: DataFrame, by: Sequence[str], value: str, aim: float) -> DataFrame:
    """The fallback: the row of each group whose value is nearest to aim, the smaller at a tie."""
    return selected(grid, by, [F.abs(F.col(value) - aim), F.col(value)])
