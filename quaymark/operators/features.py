"""Gap-safe features. All windows are over rows of one continuous segment and NULL until they are full; long series are computed in halo buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.columns import all_finite, calendar, change, clip, ratio, trading_sessions, turn

from .segments import BUCKET_BARS, in_buckets, local_segments

HORIZONS = (5, 15, 30, 60)
#: Bars that the 42 features look back at (a slope of a mean of 240), and the further ones of the second set.
LOOKBACK, LOOKBACK_MORE = 480, 121


class Rolling:
    """Window expressions within (instrument, bucket, seg), full windows only. Without segmented, windows cross gaps."""

    def __init__(self, segmented: bool = True):
        keys = ["instrument", "bucket", "seg"] if segmented else ["instrument", "bucket"]
        self.w = Window.partitionBy(*keys).orderBy("ts_ms")

    def lag(self, x: Column | str, n: int) -> Column:
        return F.lag(x, n).over(self.w)

    def lead(self, x: Column | str, n: int) -> Column:
        return F.lead(x, n).over(self.w)

    def full(self, f, x: Column | str, n: int) -> Column:
        frame = self.w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(frame) == n, f(x).over(frame))

    def mean(self, x, n):
        return self.full(F.avg, x, n)

    def std(self, x, n):
        return self.full(F.stddev_samp, x, n)

    def total(self, x, n):
        return self.full(F.sum, x, n)

    def high(self, x, n):
        return self.full(F.max, x, n)

    def low(self, x, n):
        return self.full(F.min, x, n)


def returns(r: Rolling) -> dict[str, Column]:
    return {f"return_{h}m": change(F.col("close"), r.lag("close", h)) for h in (1, 5, 15, 30, 60)}


def candle() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - l
    share = lambda x: F.when(span == 0, 0.0).otherwise(ratio(x, span))
    upper, lower = h - F.greatest(o, c), F.least(o, c) - l
    return {
        "candle_range": span, "body": c - o, "abs_body": F.abs(c - o), "upper_wick": upper, "lower_wick": lower,
        "body_range_ratio": share(F.abs(c - o)), "upper_wick_ratio": share(upper), "lower_wick_ratio": share(lower),
    }


def volatility(r: Rolling) -> dict[str, Column]:
    return {f"volatility_{n}m": r.std("return_1m", n) for n in (15, 30, 60, 240)}


def momentum(r: Rolling) -> dict[str, Column]:
    return {f"momentum_{h}m": F.col("close") - r.lag("close", h) for h in HORIZONS}


def means(r: Rolling) -> dict[str, Column]:
    return {f"sma_{n}": r.mean("close", n) for n in (15, 60, 240)}


def mean_distances(r: Rolling) -> dict[str, Column]:
    out = {f"distance_sma_{n}": change(F.col("close"), F.col(f"sma_{n}")) for n in (15, 60, 240)}
    return out | {f"sma_{n}_slope": F.col(f"sma_{n}") - r.lag(f"sma_{n}", n) for n in (15, 60, 240)}


def extremes(r: Rolling) -> dict[str, Column]:
    return {f"rolling_high_{n}": r.high("high", n) for n in (60, 240)} | {f"rolling_low_{n}": r.low("low", n) for n in (60, 240)}


def extreme_distances() -> dict[str, Column]:
    return {f"distance_{side}_{n}": change(F.col("close"), F.col(f"rolling_{side}_{n}")) for side in ("high", "low") for n in (60, 240)}


def clock() -> dict[str, Column]:
    c = calendar()
    (hs, hc), (ms, mc) = turn(c["hour"], 24), turn(c["minute"], 60)
    return {"hour_sin": hs, "hour_cos": hc, "minute_sin": ms, "minute_cos": mc}


FEATURES = (
    *(f"return_{h}m" for h in (1, 5, 15, 30, 60)), "candle_range", "body", "abs_body", "upper_wick", "lower_wick", "body_range_ratio", "upper_wick_ratio", "lower_wick_ratio",
    *(f"volatility_{n}m" for n in (15, 30, 60, 240)), *(f"momentum_{h}m" for h in HORIZONS), *(f"sma_{n}" for n in (15, 60, 240)), *(f"distance_sma_{n}" for n in (15, 60, 240)),
    *(f"sma_{n}_slope" for n in (15, 60, 240)), *(f"rolling_{s}_{n}" for s in ("high", "low") for n in (60, 240)), *(f"distance_{s}_{n}" for s in ("high", "low") for n in (60, 240)),
    "hour_sin", "hour_cos", "minute_sin", "minute_cos",
)
TARGETS = tuple(f"future_return_{h}m" for h in HORIZONS)


def _windowed(bars: DataFrame, step_ms: int, back: int, ahead: int, bucket_bars: int) -> DataFrame:
    return local_segments(in_buckets(bars, step_ms, back, ahead, bucket_bars), step_ms)


def with_features(rows: DataFrame) -> DataFrame:
    """The 42 features, for rows with instrument, bucket and seg. One sort serves all windows; the slopes take a second pass over it."""
    r = Rolling()
    rows = rows.withColumns(returns(r) | candle() | momentum(r) | means(r) | extremes(r) | clock())
    return rows.withColumns(volatility(r) | mean_distances(r) | extreme_distances())


def future_returns(r: Rolling, step_ms: int, horizons=HORIZONS) -> dict[str, Column]:
    """close after h bars / close - 1, NULL unless that bar is h steps away in the same segment."""
    exact = lambda h: r.lead("ts_ms", h) - F.col("ts_ms") == h * step_ms
    return {f"future_return_{h}m": F.when(exact(h), change(r.lead("close", h), F.col("close"))) for h in horizons}


def feature_set(bars: DataFrame, step_ms: int, targets: bool = True, need: str = "any", bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Bars with the 42 features (and the targets), where all features are there. need: any or all of the targets must be there too, or none."""
    rows = with_features(_windowed(bars, step_ms, LOOKBACK, max(HORIZONS), bucket_bars))
    if targets:
        rows = rows.withColumns(future_returns(Rolling(), step_ms))
    rows = rows.where("own").where(all_finite(*FEATURES))
    if targets and need != "none":
        rows = rows.dropna(how="all" if need == "any" else "any", subset=list(TARGETS))
    return rows.select(*bars.columns, *FEATURES, *(TARGETS if targets else ()))


def active_feature_set(active: DataFrame, step_ms: int, least_rows: int = 540, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """The same on active segments (with active_segment) of least_rows bars and more, with all targets."""
    sizes = active.groupBy("instrument", "active_segment").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows)
    bars = active.join(sizes, ["instrument", "active_segment"], "left_semi").select("instrument", "ts_ms", "open", "high", "low", "close")
    return feature_set(bars, step_ms, need="all", bucket_bars=bucket_bars)


def more_features(rows: DataFrame, step_ms: int, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """45 further features of rows that have the 42, in segments of the rows that are left."""
    r = Rolling()
    rows = local_segments(in_buckets(rows, step_ms, LOOKBACK_MORE, 0, bucket_bars), step_ms)
    span = F.col("high") - F.col("low")
    up, down = clip(F.col("return_1m"), low=0.0), clip(-F.col("return_1m"), low=0.0)
    rows = rows.withColumns({"_span": F.nullif(span, F.lit(0.0)), "_up": up, "_down": down, "_rise": (F.col("body") > 0).cast("double")})
    out = {f"ret_1_lag{k}": r.lag("return_1m", k) for k in (1, 2, 3, 5, 10, 15, 30, 60)}
    out |= {f"ret_mean_{n}": r.mean("return_1m", n) for n in (5, 15, 30, 60)} | {f"ret_std_{n}": r.std("return_1m", n) for n in (15, 30, 60)}
    out |= {"vol_ratio_15_60": ratio(F.col("volatility_15m"), F.col("volatility_60m")), "vol_ratio_30_240": ratio(F.col("volatility_30m"), F.col("volatility_240m"))}
    for n in (14, 30):
        u, d = r.mean("_up", n), r.mean("_down", n)
        out[f"rsi_{n}"] = F.when((u == 0) & (d == 0), F.lit(None)).when(d == 0, 100.0).when(u == 0, 0.0).otherwise(100 - ratio(F.lit(100.0), 1 + ratio(u, d)))
    for n in (20, 30, 60, 120):
        top, bottom = r.high("high", n), r.low("low", n)
        out[f"close_pos_{n}"] = ratio(F.col("close") - bottom, top - bottom)
        if n != 60:
            out |= {f"dist_high_{n}": change(F.col("close"), top), f"dist_low_{n}": change(F.col("close"), bottom)}
    for n in (10, 30, 60):
        out |= {f"up_frac_{n}": r.mean("_rise", n), f"body_imbalance_{n}": ratio(r.total("body", n), r.total("abs_body", n))}
    out |= {f"range_norm_mom_{n}": ratio(F.col(f"momentum_{n}m"), r.mean("_span", 20)) for n in (5, 15, 30)}
    c = calendar()
    (hs, hc), (ds, dc) = turn(c["hour"] + c["minute"] / 60, 24), turn(c["day_of_week"], 7)
    out |= {"hour2_sin": hs, "hour2_cos": hc, "dow_sin": ds, "dow_cos": dc} | trading_sessions()
    return rows.withColumns(out).where("own").drop("_span", "_up", "_down", "_rise", "bucket", "own", "seg")


def index_features(bars: DataFrame, step_ms: int, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Nine features of a second series: returns, volatility and distances to means; rows that have all."""
    r = Rolling()
    rows = _windowed(bars, step_ms, 241, 0, bucket_bars).withColumns(returns(r) | {f"sma_{n}": r.mean("close", n) for n in (60, 240)})
    rows = rows.withColumns({f"volatility_{n}m": r.std("return_1m", n) for n in (15, 60)} | {f"distance_sma_{n}": change(F.col("close"), F.col(f"sma_{n}")) for n in (60, 240)})
    names = [*(f"return_{h}m" for h in (1, 5, 15, 30, 60)), "volatility_15m", "volatility_60m", "distance_sma_60", "distance_sma_240"]
    return rows.where("own").where(all_finite(*names)).select(*bars.columns, *names)


def windows(bars: DataFrame, step_ms: int, columns, back: int, ahead: int = 0, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """bars with columns(Rolling) in segments: for windows of one's own."""
    rows = _windowed(bars, step_ms, back, ahead, bucket_bars)
    out = columns(Rolling())
    return rows.withColumns(out).where("own").select(*bars.columns, *out)
