"""Audits of bars: counters in one pass, gaps, duplicates, and the filters that make a canonical series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.columns import OHLC, aligned, all_finite, any_null, flat_candle, positive_prices, valid_ohlc

from .segments import BUCKET_BARS, with_bucket, with_previous


def canonical(bars: DataFrame, step_ms: int) -> DataFrame:
    """Aligned, valid, positive bars; flat bars and duplicate times stay."""
    return bars.where(aligned(step_ms) & valid_ohlc() & positive_prices())


def first_of_time(rows: DataFrame, order: list[str], ts: str = "ts_ms") -> DataFrame:
    """Of rows of the same instrument and time the first by order."""
    w = Window.partitionBy("instrument", ts).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def guard_strict(bars: DataFrame) -> DataFrame:
    """Raises at the next action if an instrument has a time twice: sorted, times are then strictly increasing."""
    w = Window.partitionBy("instrument", "ts_ms")
    once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("duplicate time")).cast("boolean"))
    return bars.withColumn("_n", F.count("*").over(w)).where(once).drop("_n")


def with_gaps(rows: DataFrame, by: list[str], order: list[str], ts: str = "ts_ms", step_ms: int = 60_000, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Adds gap: the step from the row before, in the given order. In an order by time, a series is cut into buckets of bucket_bars steps; only an order of
    another kind (that of a file) is one window for each group."""
    if order[0] != ts:
        return rows.withColumn("gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(*order)))
    before = with_previous(with_bucket(rows, bucket_bars * step_ms, ts), ts, "_before", by, order)
    return before.withColumn("gap", F.col(ts) - F.col("_before")).select(*rows.columns, "gap")


def audit(rows: DataFrame, step_ms: int, by: list[str], order: list[str]) -> DataFrame:
    """Counters of each group in one pass over rows in the given order; gaps and flat bars alone don't fail it."""
    gaps = with_gaps(rows, by, order, step_ms=step_ms)
    counts = {
        "n_rows": F.lit(True), "n_missing": any_null("ts_ms", *OHLC), "n_backward": F.col("gap") <= 0, "n_not_positive": ~positive_prices(), "n_invalid": ~valid_ohlc(),
        "n_gaps": F.col("gap") > step_ms, "n_flat": flat_candle(), "n_unaligned": ~aligned(step_ms), "n_not_finite": ~all_finite(*OHLC),
    }
    out = gaps.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in counts.items()], (F.count("ts_ms") - F.count_distinct("ts_ms")).alias("n_duplicates"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max("gap").alias("longest_gap"))
    bad = F.col("n_missing") + F.col("n_duplicates") + F.col("n_backward") + F.col("n_not_positive") + F.col("n_invalid")
    return out.withColumn("passed", bad == 0)


def interval_classes(bars: DataFrame, step_ms: int) -> DataFrame:
    gaps = with_gaps(bars, ["instrument"], ["ts_ms"], step_ms=step_ms).where("gap is not null")
    return gaps.groupBy("instrument").agg(F.count_if(F.col("gap") == step_ms).alias("n_exact"), F.count_if(F.col("gap") > step_ms).alias("n_longer"), F.count_if(F.col("gap") < step_ms).alias("n_shorter"), F.max("gap").alias("longest"))


def longest_gaps(bars: DataFrame, step_ms: int, k: int = 20) -> DataFrame:
    """The k longest gaps of all, with the times before and after."""
    gaps = with_gaps(bars, ["instrument"], ["ts_ms"], step_ms=step_ms).where(F.col("gap") > step_ms)
    return gaps.orderBy(F.desc("gap"), "instrument", "ts_ms").limit(k).select("instrument", (F.col("ts_ms") - F.col("gap")).alias("before_ms"), F.col("ts_ms").alias("after_ms"), "gap")


def overlaps(spans: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of (name, start_ms, end_ms) rows that overlap, each once.

    A span's level is the power of two above its length, and its cells are that wide, so it is in two at most. It also visits the cells of all levels above that spans
    have (64 at most). Two spans meet at the level of the longer, in the first cell that both are in; so one long span doesn't bring short ones together.
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    levels = spans.withColumn("level", F.ceil(F.log2(length)).cast("int"))
    present = levels.agg(F.collect_set("level").alias("_levels"))
    visits = levels.crossJoin(F.broadcast(present)).withColumn("at", F.explode(F.filter("_levels", lambda x: x >= F.col("level"))))
    width = F.expr("shiftleft(1L, at)")
    first, last = F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width)
    cut = visits.withColumn("first", first).withColumn("cell", F.explode(F.sequence(first, last)))
    side = lambda x: [F.col("name").alias(x), F.col("start_ms").alias(f"s{x}"), F.col("end_ms").alias(f"e{x}"), F.col("first").alias(f"f{x}"), F.col("level").alias(f"l{x}")]
    home = cut.where("at = level").select("at", "cell", *side("a"))
    met = home.join(cut.select("at", "cell", *side("b")), ["at", "cell"])
    met = met.where((F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea")) & (F.col("cell") == F.greatest("fa", "fb")) & ((F.col("la") > F.col("lb")) & (F.col("a") != F.col("b")) | (F.col("la") == F.col("lb")) & (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.least("ea", "eb") - F.greatest("sa", "sb")).alias("overlap_ms"))


def feature_audit(rows: DataFrame, features: list[str], by: list[str], step_ms: int) -> DataFrame:
    """One row for each group of a feature table: its rows, incomplete ones, null, NaN and infinite values, backward steps and duplicate times, and whether it
    passes (no NaN, infinity, backward step or duplicate; null marks a warm-up and is allowed)."""
    gaps = with_gaps(rows, by, ["ts_ms"], step_ms=step_ms)
    total = lambda f: sum((F.count_if(f(F.col(c))) for c in features), F.lit(0))
    nulls = [F.col(c).isNull() for c in features]
    some_null = nulls[0]
    for x in nulls[1:]:
        some_null |= x
    out = gaps.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(some_null).alias("n_incomplete"), total(lambda c: c.isNull()).alias("n_null"), total(F.isnan).alias("n_nan"), total(lambda c: F.abs(c) == float("inf")).alias("n_infinite"),
        F.count_if(F.col("gap") < 0).alias("n_backward"), F.count_if(F.col("gap") == 0).alias("n_duplicates"), F.count_if(F.col("gap") > step_ms).alias("n_gaps"),
    )
    return out.withColumn("passed", F.col("n_nan") + F.col("n_infinite") + F.col("n_backward") + F.col("n_duplicates") == 0)


def boundary_gaps(spans: DataFrame) -> DataFrame:
    """Each span with the next one and the gap between. Spans are few, one for each file, so they are one window."""
    w = Window.orderBy("start_ms", "name")
    return spans.select("name", F.lead("name").over(w).alias("next_name"), (F.lead("start_ms").over(w) - F.col("end_ms")).alias("gap_ms")).where("next_name is not null")


def series_verdict(bars: DataFrame, feature_rows: DataFrame, features: list[str], step_ms: int) -> DataFrame:
    """One row for each instrument of a second series: the audit of its bars and of its features, the intervals that aren't one step, and verdict PASS or FAIL. Gaps alone don't fail it."""
    own = audit(bars, step_ms, ["instrument"], ["ts_ms"]).select("instrument", "n_rows", "n_missing", "n_not_positive", "n_invalid", "n_backward", "n_duplicates", "first_ms", "last_ms")
    other = interval_classes(bars, step_ms).select("instrument", (F.col("n_longer") + F.col("n_shorter")).alias("n_not_one_step"))
    fed = feature_audit(feature_rows, features, ["instrument"], step_ms).select("instrument", F.col("n_rows").alias("n_feature_rows"), (F.col("n_nan") + F.col("n_infinite") + F.col("n_null")).alias("n_features_not_finite"))
    out = own.join(other, "instrument", "left").join(fed, "instrument", "left").fillna(0, ["n_not_one_step", "n_feature_rows", "n_features_not_finite"])
    bad = F.col("n_missing") + F.col("n_not_positive") + F.col("n_invalid") + F.col("n_backward") + F.col("n_duplicates") + F.col("n_features_not_finite")
    return out.withColumn("verdict", F.when(bad == 0, "PASS").otherwise("FAIL"))
