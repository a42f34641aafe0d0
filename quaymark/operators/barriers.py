"""Forward-looking labels: directions, and triple barriers by first touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import Rolling
from .segments import BUCKET_BARS, in_buckets, local_segments

SHORT, TIMEOUT, LONG, AMBIGUOUS, INVALID, CLOSED = 0, 1, 2, -1, -2, -3
#: What was hit: the lower barrier, the end, the upper one, both in one bar, nothing.
LOWER, VERTICAL, UPPER, BOTH, NONE = 0, 1, 2, 3, -1


def _touch(width: Column, horizon: int, ahead: Column) -> Column:
    """label, hit and the exit bar from the bars ahead: the first that reaches close * (1 +- width); both in one bar are ambiguous, none is a timeout."""
    upper, lower = F.col("close") * (1 + width), F.col("close") * (1 - width)
    first = F.get(F.filter(ahead, lambda b: (b["high"] >= upper) | (b["low"] <= lower)), F.lit(0))
    up, down = first["high"] >= upper, first["low"] <= lower
    end = F.get(ahead, F.lit(horizon - 1))
    label = F.when(first.isNull(), TIMEOUT).when(up & down, AMBIGUOUS).when(up, LONG).otherwise(SHORT)
    hit = F.when(first.isNull(), VERTICAL).when(up & down, BOTH).when(up, UPPER).otherwise(LOWER)
    bar = F.coalesce(first, end)
    there = (F.size(ahead) == horizon) & width.isNotNull()
    return F.struct(
        F.when(there, label).otherwise(INVALID).cast("int").alias("label"), F.when(there, hit).otherwise(NONE).cast("int").alias("hit"),
        F.when(there, bar["ts_ms"]).alias("exit_ms"), F.when(there, bar["close"]).alias("exit_close"),
    )


def _ahead(horizon: int) -> Column:
    frame = Window.partitionBy("instrument", "bucket", "seg").orderBy("ts_ms").rowsBetween(1, horizon)
    return F.collect_list(F.struct("ts_ms", "high", "low", "close")).over(frame)


def triple_barrier(bars: DataFrame, step_ms: int, configs: Sequence[tuple[float, int]], bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """One row for each bar and (width, horizon) of configs: width, horizon, label, hit, exit_ms, exit_close, elapsed (minutes). A bar without horizon bars ahead
    in its segment is invalid. The bars ahead are collected once, for the longest horizon: at most that many a row."""
    longest = max(h for _, h in configs)
    return touches(local_segments(in_buckets(bars, step_ms, 0, longest, bucket_bars), step_ms), configs).select(*bars.columns, *TOUCHED)


TOUCHED = ("width", "horizon", "label", "hit", "exit_ms", "exit_close", "elapsed")


def touches(rows: DataFrame, configs: Sequence[tuple[float, int]]) -> DataFrame:
    """triple_barrier() of the own bars of rows with instrument, bucket, seg and own, whose buckets hold the bars ahead."""
    longest = max(h for _, h in configs)
    ahead = rows.withColumn("_ahead", _ahead(longest)).where("own")
    cells = [F.struct(F.lit(float(w)).alias("width"), F.lit(h).alias("horizon"), _touch(F.lit(float(w)), h, F.slice("_ahead", 1, h)).alias("t")) for w, h in configs]
    out = ahead.withColumn("_c", F.explode(F.array(*cells)))
    return out.select(*rows.columns, "_c.width", "_c.horizon", "_c.t.label", "_c.t.hit", "_c.t.exit_ms", "_c.t.exit_close", ((F.col("_c.t.exit_ms") - F.col("ts_ms")) / 60_000).alias("elapsed"))


def trailing_volatility(r: Rolling, n: int) -> dict[str, Column]:
    """Standard deviation of the n log returns that end at the bar before, all in the segment."""
    frame = r.w.rowsBetween(-n, -1)
    return {"volatility": F.when(F.count("_log").over(frame) == n, F.stddev_samp("_log").over(frame))}


def dynamic_barrier(bars: DataFrame, step_ms: int, multipliers: Sequence[float], horizon: int = 60, lookback: int = 60, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Triple barriers of width multiplier * volatility * sqrt(horizon), one row for each bar and multiplier; no or zero volatility is invalid."""
    rows = local_segments(in_buckets(bars, step_ms, lookback + 1, horizon, bucket_bars), step_ms)
    r = Rolling()
    both = (F.col("close") > 0) & (r.lag("close", 1) > 0)
    rows = rows.withColumn("_log", F.when(both, F.log(F.try_divide(F.col("close"), r.lag("close", 1)))))
    rows = rows.withColumns(trailing_volatility(r, lookback) | {"_ahead": _ahead(horizon)}).where("own")
    sigma = F.when(F.col("volatility") > 0, F.col("volatility"))
    width = lambda m: F.lit(float(m)) * sigma * F.sqrt(F.lit(float(horizon)))
    cells = [F.struct(F.lit(float(m)).alias("multiplier"), width(m).alias("width"), _touch(width(m), horizon, F.col("_ahead")).alias("t")) for m in multipliers]
    out = rows.withColumn("_c", F.explode(F.array(*cells)))
    return out.select(*bars.columns, "volatility", "_c.multiplier", "_c.width", "_c.t.label", "_c.t.hit", "_c.t.exit_ms", "_c.t.exit_close")


def session_barrier(masked: DataFrame, step_ms: int, multipliers: Sequence[float], horizon: int = 60, lookback: int = 60, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Dynamic barriers on active segments; closed bars are labelled CLOSED. masked has closed."""
    names = ["instrument", "ts_ms", "open", "high", "low", "close"]
    out = dynamic_barrier(masked.where("not closed").select(*names), step_ms, multipliers, horizon, lookback, bucket_bars)
    shut = masked.where("closed").select(*names).withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    return out.unionByName(shut.withColumns({"label": F.lit(CLOSED), "hit": F.lit(NONE)}), allowMissingColumns=True)


def direction(masked: DataFrame, step_ms: int, horizon: int, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """direction 1 if the close after horizon bars is higher, 0 if not, -1 unless that bar is there in time and both bars are active; with exit_ms."""
    rows = local_segments(in_buckets(masked, step_ms, 0, horizon, bucket_bars), step_ms)
    r = Rolling()
    ok = (r.lead("ts_ms", horizon) - F.col("ts_ms") == horizon * step_ms) & ~F.col("closed") & ~r.lead("closed", horizon)
    up = (r.lead("close", horizon) > F.col("close")).cast("int")
    out = {"direction": F.when(ok, up).otherwise(-1), "exit_ms": F.when(ok, r.lead("ts_ms", horizon))}
    return rows.withColumns(out).where("own").select(*masked.columns, *out)


def event_target(label: Column) -> Column:
    """1 if a barrier is hit, 0 at a timeout."""
    return F.when(label.isin(SHORT, LONG), 1).when(label == TIMEOUT, 0)


def direction_target(label: Column) -> Column:
    """Given an event: 1 long, 0 short."""
    return F.when(label == LONG, 1).when(label == SHORT, 0)


def invalid_reasons(bars: DataFrame, step_ms: int, horizon: int = 60, lookback: int = 60, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """reason of every bar, exactly one: bad_price, structural (too little before or after it in the segment), zero_volatility or usable."""
    rows = local_segments(in_buckets(bars, step_ms, lookback + 1, horizon, bucket_bars), step_ms)
    r = Rolling()
    rows = rows.withColumn("_log", F.when((F.col("close") > 0) & (r.lag("close", 1) > 0), F.log(F.try_divide(F.col("close"), r.lag("close", 1)))))
    rows = rows.withColumns(trailing_volatility(r, lookback) | {"_past": r.lag("ts_ms", lookback + 1), "_next": r.lead("ts_ms", horizon)}).where("own")
    reason = F.when(F.col("close") <= 0, "bad_price").when(F.col("_past").isNull() | F.col("_next").isNull(), "structural").when(F.coalesce(F.col("volatility"), F.lit(0.0)) <= 0, "zero_volatility").otherwise("usable")
    return rows.select(*bars.columns, reason.alias("reason"))
