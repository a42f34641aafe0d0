"""Queries over bars, with their DuckDB SQL: registered as (name, function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.functions import columns as C
from quaymark.operators import align, barriers, diagnostics, features, metrics, quality, segments, simulate, splits
from quaymark.operators.features import FEATURES, HORIZONS, TARGETS
from quaymark.sources import tables as src

from . import substrate as sub
from .substrate import SQL, with_bars
from .substrate import segments as seg

DAY, HOUR, MINUTE = src.DAY, src.HOUR, src.MINUTE
OHLC = ["instrument", "ts_ms", "open", "high", "low", "close"]
FOUND: list[tuple[str, Callable, str | None]] = []


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, never -0.0."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a function; the doubles of its SQL are rounded as rounded() does."""

    def put(f):
        text = sql
        if text is not None and doubles:
            cells = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles.split())
            text = f"SELECT * REPLACE ({cells}) FROM ({text})"
        FOUND.append((name, lambda spark, d: rounded(f(spark, d), digits), text))
        return f

    return put


PRICES = "open high low close"


# scans, filters and audits
@query("s01_hour_bars", f"SELECT * FROM ({SQL['h1']})", PRICES)
def _(spark, d):
    return sub.hour_bars(spark, d)


@query("s03_hour_bars_by_type", f"SELECT * FROM ({SQL['ht']})", PRICES)
def _(spark, d):
    return sub.hour_bars_by_type(spark, d)


@query("s06_day_bars", f"SELECT * FROM ({SQL['d1']})", PRICES)
def _(spark, d):
    return sub.day_bars(spark, d)


@query("s07_coerced_numbers", """SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number FROM events""")
def _(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return src.coerced(src.table(spark, d, "events").select("event_id", text.alias("number")), ["number"])


@query("s08_epoch_unit", "SELECT event_id, epoch_us(ts) // 1000 AS t FROM events")
def _(spark, d):
    return src.detect_epoch_ms(src.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), "t")


@query("s09_parsed_times", "SELECT o_orderkey, epoch_ms(o_orderdate) AS t FROM orders")
def _(spark, d):
    return src.parse_times(src.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t")), "t")


_AUDIT = """SELECT {by}, count(*) AS n_rows, count(*) FILTER (ts_ms IS NULL OR "open" IS NULL OR high IS NULL OR low IS NULL OR "close" IS NULL) AS n_missing, count(*) FILTER (gap <= 0) AS n_backward,
 count(*) FILTER (NOT least("open", high, low, "close") > 0) AS n_not_positive, count(*) FILTER (NOT (high >= "open" AND high >= "close" AND low <= "open" AND low <= "close" AND high >= low)) AS n_invalid,
 count(*) FILTER (gap > {step}) AS n_gaps, count(*) FILTER ("open" = high AND high = low AND low = "close") AS n_flat, count(*) FILTER (ts_ms % {step} <> 0) AS n_unaligned, 0::BIGINT AS n_not_finite,
 count(ts_ms) - count(DISTINCT ts_ms) AS n_duplicates, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(gap) AS longest_gap FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY {by} ORDER BY ts_ms) AS gap FROM {source}) GROUP BY {by}"""
_PASSED = "SELECT *, n_missing + n_duplicates + n_backward + n_not_positive + n_invalid = 0 AS passed FROM ({})"


@query("p19_audit_by_instrument", with_bars("ht", _PASSED.format(_AUDIT.format(by="instrument", step=HOUR, source="b"))))
def _(spark, d):
    return quality.audit(sub.hour_bars_by_type(spark, d), HOUR, ["instrument"], ["ts_ms"])


@query("p20_audit_of_series", with_bars("m1", _PASSED.format(_AUDIT.format(by="instrument", step=MINUTE, source="b"))))
def _(spark, d):
    return quality.audit(sub.minute_bars(spark, d), MINUTE, ["instrument"], ["ts_ms"])


@query("p07_canonical", with_bars("m1", 'SELECT * FROM b WHERE ts_ms % 60000 = 0 AND high >= "open" AND high >= "close" AND low <= "open" AND low <= "close" AND high >= low AND least("open", high, low, "close") > 0'), PRICES)
def _(spark, d):
    return quality.canonical(sub.minute_bars(spark, d), MINUTE)


@query("p15_years", with_bars("d1", "SELECT CAST(year(make_timestamp(ts_ms * 1000)) AS INT) AS year, count(*) AS n FROM b GROUP BY 1"))
def _(spark, d):
    return diagnostics.with_year(sub.day_bars(spark, d)).groupBy("year").agg(F.count("*").alias("n"))


@query("a12_duplicate_times", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates, count(*) AS n_rows FROM lineitem")
def _(spark, d):
    return src.table(spark, d, "lineitem").agg((F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("n_duplicates"), F.count("*").alias("n_rows"))


@query("t08_first_of_time", "SELECT instrument, ts_ms, l_partkey FROM (SELECT 'lines' AS instrument, epoch_ms(l_shipdate) AS ts_ms, l_partkey, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    rows = src.table(spark, d, "lineitem").select(F.lit("lines").alias("instrument"), C.epoch_ms("l_shipdate").alias("ts_ms"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return quality.first_of_time(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("instrument", "ts_ms", "l_partkey")


_GAPS = "g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY instrument ORDER BY ts_ms) AS gap FROM b)"


@query("a19_interval_classes", with_bars("m1", "SELECT instrument, count(*) FILTER (gap = 60000) AS n_exact, count(*) FILTER (gap > 60000) AS n_longer, count(*) FILTER (gap < 60000) AS n_shorter, max(gap) AS longest FROM g WHERE gap IS NOT NULL GROUP BY 1", _GAPS))
def _(spark, d):
    return quality.interval_classes(sub.minute_bars(spark, d), MINUTE)


@query("w19_longest_gaps", with_bars("m1", "SELECT instrument, ts_ms - gap AS before_ms, ts_ms AS after_ms, gap FROM g WHERE gap > 60000 ORDER BY gap DESC, instrument, ts_ms LIMIT 20", _GAPS))
def _(spark, d):
    return quality.longest_gaps(sub.minute_bars(spark, d), MINUTE)


_SPANS = "sp AS (SELECT instrument AS name, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM b GROUP BY 1)"


def _spans(spark, d):
    return sub.hour_bars_by_type(spark, d).groupBy(F.col("instrument").alias("name")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


@query("j12_overlaps", with_bars("ht", "SELECT a.name AS a, b2.name AS b, least(a.end_ms, b2.end_ms) - greatest(a.start_ms, b2.start_ms) AS overlap_ms FROM sp a JOIN sp b2 ON a.name < b2.name AND a.start_ms <= b2.end_ms AND b2.start_ms <= a.end_ms", _SPANS))
def _(spark, d):
    return quality.overlaps(_spans(spark, d))


@query("j13_boundary_gaps", with_bars("ht", "SELECT * FROM (SELECT name, lead(name) OVER (ORDER BY start_ms, name) AS next_name, lead(start_ms) OVER (ORDER BY start_ms, name) - end_ms AS gap_ms FROM sp) WHERE next_name IS NOT NULL", _SPANS))
def _(spark, d):
    return quality.boundary_gaps(_spans(spark, d))


# segments and runs
@query("w02_gap_segments", with_bars("m1", "SELECT instrument, ts_ms, CAST(segment AS BIGINT) AS segment FROM s", seg(MINUTE)))
def _(spark, d):
    return segments.gap_segments(sub.minute_bars(spark, d), MINUTE).select("instrument", "ts_ms", "segment")


@query("a17_segment_statistics", with_bars("m1", "SELECT instrument, count(*) AS n, min(n) AS shortest, median(n) AS median, max(n) AS longest, count(*) FILTER (n >= 5) AS n_eligible, CAST(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS BIGINT) AS rows_eligible FROM (SELECT instrument, segment, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1", seg(MINUTE)))
def _(spark, d):
    return diagnostics.segment_statistics(segments.segment_table(segments.gap_segments(sub.minute_bars(spark, d), MINUTE), "segment", MINUTE), 5)


def _runs_sql(across: bool) -> tuple[str, ...]:
    same = '"close" = lag("close") OVER w' + ("" if across else " AND segment = lag(segment) OVER w")
    return (
        seg(HOUR),
        f"r0 AS (SELECT *, CASE WHEN {same} THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms))",
        "r1 AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY ts_ms) AS run FROM r0)",
        "r AS (SELECT *, count(*) OVER (PARTITION BY instrument, run) AS run_length FROM r1)",
    )


def _runs(spark, d, across=False):
    return segments.flat_runs(sub.coarse_hour_bars(spark, d), HOUR, across)


_RUNS = "SELECT instrument, ts_ms, CAST(run AS BIGINT) AS run, run_length FROM r"


@query("w03_flat_runs", with_bars("hq", _RUNS, *_runs_sql(False)))
def _(spark, d):
    return _runs(spark, d).select("instrument", "ts_ms", "run", "run_length")


@query("w04_flat_runs_across_gaps", with_bars("hq", _RUNS, *_runs_sql(True)))
def _(spark, d):
    return _runs(spark, d, True).select("instrument", "ts_ms", "run", "run_length")


_ACTIVE = "a AS (SELECT instrument, ts_ms, \"open\", high, low, \"close\" FROM r WHERE run_length < 3)"


@query("w06_active_segments", with_bars("hq", f"SELECT instrument, CAST(segment AS BIGINT) AS active_segment, min(ts_ms) AS start_ms, max(ts_ms) + {HOUR} AS end_ms, count(*) AS length FROM sa GROUP BY 1, 2", *_runs_sql(False), _ACTIVE, seg(HOUR, "a", "sa")))
def _(spark, d):
    return segments.segment_table(segments.active_segments(segments.closed_mask(_runs(spark, d), 3), HOUR), "active_segment", HOUR)


@query("a05_flat_summary", with_bars("hq", "SELECT CAST(year(make_timestamp(ts_ms * 1000)) AS INT) AS year, count(*) AS n_rows, count(*) FILTER (run_length >= 3) AS n_closed, 100.0::DOUBLE * count(*) FILTER (run_length >= 3) / count(*) AS closed_pct, count(*) FILTER (run_length < 3) AS n_active, count(*) FILTER (run_length >= 2) AS n_flat2 FROM r GROUP BY 1", *_runs_sql(False)), "closed_pct")
def _(spark, d):
    return diagnostics.flat_summary(_runs(spark, d), 3)


@query("a18_run_histogram", with_bars("hq", "SELECT instrument, t AS threshold, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT instrument, run, count(*) AS n FROM r GROUP BY 1, 2), (VALUES (1), (2), (3), (5), (8)) v(t) WHERE n >= t GROUP BY 1, 2", *_runs_sql(False)))
def _(spark, d):
    return diagnostics.run_histogram(_runs(spark, d), [1, 2, 3, 5, 8])


# features
def _full(agg: str, x: str, n: int, w: str = "s") -> str:
    over = f"OVER (PARTITION BY instrument, segment ORDER BY ts_ms ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg}({x}) {over} END"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY instrument, segment ORDER BY ts_ms)"


def _lead(x: str, n: int) -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY instrument, segment ORDER BY ts_ms)"


def _named(cells: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in cells.items())


_CLOSE = '"close"'
_UPPER, _LOWER, _BODY = 'high - greatest("open", "close")', 'least("open", "close") - low', 'abs("close" - "open")'
_HOUR_OF, _MINUTE_OF = "hour(make_timestamp(ts_ms * 1000))", "minute(make_timestamp(ts_ms * 1000))"
_TURN = "6.283185307179586::DOUBLE"
FIRST = (
    {f"return_{h}m": f"{_CLOSE} / nullif({_lag(_CLOSE, h)}, 0) - 1" for h in (1, 5, 15, 30, 60)}
    | {"candle_range": "high - low", "body": '"close" - "open"', "abs_body": _BODY, "upper_wick": _UPPER, "lower_wick": _LOWER}
    | {f"{n}_ratio": f"CASE WHEN high - low = 0 THEN 0.0::DOUBLE ELSE ({x}) / nullif(high - low, 0) END" for n, x in (("body_range", _BODY), ("upper_wick", _UPPER), ("lower_wick", _LOWER))}
    | {f"momentum_{h}m": f"{_CLOSE} - {_lag(_CLOSE, h)}" for h in HORIZONS}
    | {f"sma_{n}": _full("avg", _CLOSE, n) for n in (15, 60, 240)}
    | {f"rolling_high_{n}": _full("max", "high", n) for n in (60, 240)}
    | {f"rolling_low_{n}": _full("min", "low", n) for n in (60, 240)}
    | {"hour_sin": f"sin({_HOUR_OF} * ({_TURN} / 24))", "hour_cos": f"cos({_HOUR_OF} * ({_TURN} / 24))", "minute_sin": f"sin({_MINUTE_OF} * ({_TURN} / 60))", "minute_cos": f"cos({_MINUTE_OF} * ({_TURN} / 60))"}
)
SECOND = (
    {f"volatility_{n}m": _full("stddev_samp", "return_1m", n) for n in (15, 30, 60, 240)}
    | {f"distance_sma_{n}": f"{_CLOSE} / nullif(sma_{n}, 0) - 1" for n in (15, 60, 240)}
    | {f"sma_{n}_slope": f"sma_{n} - {_lag(f'sma_{n}', n)}" for n in (15, 60, 240)}
    | {f"distance_{s}_{n}": f"{_CLOSE} / nullif(rolling_{s}_{n}, 0) - 1" for s in ("high", "low") for n in (60, 240)}
    | {f"future_return_{h}m": f"CASE WHEN {_lead('ts_ms', h)} - ts_ms = {h} * STEP::BIGINT THEN {_lead(_CLOSE, h)} / nullif({_CLOSE}, 0) - 1 END" for h in HORIZONS}
)


def feature_ctes(step: int, source: str = "b", name: str = "f") -> tuple[str, ...]:
    """CTE name: source with segment, all features and targets."""
    return (seg(step, source, f"{name}s"), f"{name}1 AS (SELECT *, {_named(FIRST)} FROM {name}s)", f"{name} AS (SELECT *, {_named(SECOND).replace('STEP', str(step))} FROM {name}1)")


def _family(name: str, columns: list[str], table: str = "h1", step: int = HOUR, frame=sub.hour_bars):
    """One query for each family of features: the bars and the family's columns, NULL where windows aren't full."""
    listed = ", ".join(columns)

    def run(spark, d):
        rows = features.with_features(segments.local_segments(segments.in_buckets(frame(spark, d), step, 480), step))
        return rows.where("own").select("instrument", "ts_ms", *columns)

    query(name, with_bars(table, f"SELECT instrument, ts_ms, {listed} FROM f", *feature_ctes(step)), " ".join(columns))(run)


_family("w16_returns", [f"return_{h}m" for h in (1, 5, 15, 30, 60)])
_family("f01_candles", [c for c in FEATURES if "wick" in c or "body" in c or c == "candle_range"], "m1", MINUTE, sub.minute_bars)
_family("w09_rolling_std", [f"volatility_{n}m" for n in (15, 30, 60, 240)], "d1", DAY, sub.day_bars)
_family("w07_momentum", [f"momentum_{h}m" for h in HORIZONS], "ht", HOUR, sub.hour_bars_by_type)
_family("w10_rolling_mean", [f"sma_{n}" for n in (15, 60, 240)] + [f"distance_sma_{n}" for n in (15, 60, 240)], "d1", DAY, sub.day_bars)
_family("w13_slopes", [f"sma_{n}_slope" for n in (15, 60, 240)], "d1", DAY, sub.day_bars)
_family("w11_rolling_extremes", [f"{p}_{s}_{n}" for p in ("rolling", "distance") for s in ("high", "low") for n in (60, 240)], "d1", DAY, sub.day_bars)
_family("f02_cyclic_time", ["hour_sin", "hour_cos", "minute_sin", "minute_cos"], "m1", MINUTE, sub.minute_bars)

_ALL_FEATURES = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
_ANY_TARGET = "coalesce(" + ", ".join(TARGETS) + ") IS NOT NULL"
_ALL_TARGETS = " AND ".join(f"{c} IS NOT NULL" for c in TARGETS)
_OUT = f'instrument, ts_ms, "open", high, low, "close", {", ".join(FEATURES)}, {", ".join(TARGETS)}'


@query("feature_set_v3", with_bars("h1", f"SELECT {_OUT} FROM f WHERE {_ALL_FEATURES} AND {_ANY_TARGET}", *feature_ctes(HOUR)), " ".join([PRICES, *FEATURES, *TARGETS]))
def feature_set_v3(spark, d):
    return features.feature_set(sub.hour_bars(spark, d), HOUR)


#: Without prices and their differences, whose decimals end where rounding would cut.
_RATIOS = [c for c in (*FEATURES, *TARGETS) if c.startswith(("return", "future", "distance", "volatility", "hour", "minute")) or c.endswith("ratio")]


@query("feature_set_days", with_bars("d1", f"SELECT instrument, ts_ms, {', '.join(_RATIOS)} FROM f WHERE {_ALL_FEATURES} AND {_ANY_TARGET}", *feature_ctes(DAY)), " ".join(_RATIOS))
def _(spark, d):
    return features.feature_set(sub.day_bars(spark, d), DAY).select("instrument", "ts_ms", *_RATIOS)


@query("feature_set_v4_active", with_bars("d1", f"SELECT instrument, ts_ms, {', '.join(_RATIOS)} FROM f WHERE {_ALL_FEATURES} AND {_ALL_TARGETS}", seg(DAY, "b", "z"), "k AS (SELECT instrument, segment FROM z GROUP BY 1, 2 HAVING count(*) >= 540)",
       'c AS (SELECT z.* EXCLUDE (segment) FROM z JOIN k USING (instrument, segment))', *feature_ctes(DAY, "c")), " ".join(_RATIOS))
def _(spark, d):
    return features.active_feature_set(segments.gap_segments(sub.day_bars(spark, d), DAY).withColumnRenamed("segment", "active_segment"), DAY).select("instrument", "ts_ms", *_RATIOS)


_INDEX = [*(f"return_{h}m" for h in (1, 5, 15, 30, 60)), "volatility_15m", "volatility_60m", "distance_sma_60", "distance_sma_240"]


@query("usd_index_features", with_bars("o1", f'SELECT instrument, ts_ms, "open", high, low, "close", {", ".join(_INDEX)} FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _INDEX)}', *feature_ctes(DAY)), " ".join([PRICES, *_INDEX]))
def _(spark, d):
    return features.index_features(sub.order_day_bars(spark, d), DAY)


def _more_sql() -> tuple[dict[str, str], dict[str, str]]:
    first = {"q_span": "nullif(high - low, 0)", "q_up": "greatest(return_1m, 0.0::DOUBLE)", "q_down": "greatest(-return_1m, 0.0::DOUBLE)", "q_rise": "CASE WHEN body > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"}
    out = {f"ret_1_lag{k}": _lag("return_1m", k) for k in (1, 2, 3, 5, 10, 15, 30, 60)}
    out |= {f"ret_mean_{n}": _full("avg", "return_1m", n) for n in (5, 15, 30, 60)} | {f"ret_std_{n}": _full("stddev_samp", "return_1m", n) for n in (15, 30, 60)}
    out |= {"vol_ratio_15_60": "volatility_15m / nullif(volatility_60m, 0)", "vol_ratio_30_240": "volatility_30m / nullif(volatility_240m, 0)"}
    for n in (14, 30):
        u, v = _full("avg", "q_up", n), _full("avg", "q_down", n)
        out[f"rsi_{n}"] = f"CASE WHEN ({u}) = 0 AND ({v}) = 0 THEN NULL WHEN ({v}) = 0 THEN 100.0::DOUBLE WHEN ({u}) = 0 THEN 0.0::DOUBLE ELSE 100 - 100.0::DOUBLE / (1 + ({u}) / nullif(({v}), 0)) END"
    for n in (20, 30, 60, 120):
        top, low = _full("max", "high", n), _full("min", "low", n)
        out[f"close_pos_{n}"] = f"({_CLOSE} - ({low})) / nullif(({top}) - ({low}), 0)"
        if n != 60:
            out |= {f"dist_high_{n}": f"{_CLOSE} / nullif(({top}), 0) - 1", f"dist_low_{n}": f"{_CLOSE} / nullif(({low}), 0) - 1"}
    for n in (10, 30, 60):
        out |= {f"up_frac_{n}": _full("avg", "q_rise", n), f"body_imbalance_{n}": f"({_full('sum', 'body', n)}) / nullif(({_full('sum', 'abs_body', n)}), 0)"}
    out |= {f"range_norm_mom_{n}": f"momentum_{n}m / nullif(({_full('avg', 'q_span', 20)}), 0)" for n in (5, 15, 30)}
    hours, days = f"({_HOUR_OF} + {_MINUTE_OF} / 60.0::DOUBLE)", "(isodow(make_timestamp(ts_ms * 1000)) - 1)"
    out |= {"hour2_sin": f"sin({hours} * ({_TURN} / 24))", "hour2_cos": f"cos({hours} * ({_TURN} / 24))", "dow_sin": f"sin({days} * ({_TURN} / 7))", "dow_cos": f"cos({days} * ({_TURN} / 7))"}
    flags = {"session_london": (7, 16), "session_newyork": (13, 21), "session_overlap": (13, 16)}
    return first, out | {k: f"CAST({_HOUR_OF} >= {a} AND {_HOUR_OF} < {b} AS INT)" for k, (a, b) in flags.items()}


_Q, _MORE = _more_sql()


@query("feature_set_v5", with_bars("d1", f'SELECT instrument, ts_ms, {", ".join(_MORE)} FROM m', *feature_ctes(DAY), f"v AS (SELECT {_OUT}, {_named(_Q)} FROM f WHERE {_ALL_FEATURES} AND {_ANY_TARGET})", seg(DAY, "v", "vs"), f"m AS (SELECT instrument, ts_ms, {_named(_MORE)} FROM vs)"),
       " ".join(c for c in _MORE if not c.startswith("session")))
def _(spark, d):
    return features.more_features(features.feature_set(sub.day_bars(spark, d), DAY), DAY).select("instrument", "ts_ms", *_MORE)


@query("w14_trailing_volatility", with_bars("d1", "SELECT instrument, ts_ms, CASE WHEN count(lr) OVER w = 60 THEN stddev_samp(lr) OVER w END AS volatility FROM t WINDOW w AS (PARTITION BY instrument, segment ORDER BY ts_ms ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)",
       seg(DAY), f"t AS (SELECT *, ln({_CLOSE} / {_lag(_CLOSE, 1)}) AS lr FROM s)"), "volatility", 8)
def _(spark, d):
    rows = features.windows(sub.day_bars(spark, d), DAY, lambda r: {"_log": F.log(C.ratio(F.col("close"), r.lag("close", 1)))}, 1)
    return features.windows(rows, DAY, lambda r: barriers.trailing_volatility(r, 60), 61).select("instrument", "ts_ms", "volatility")


@query("w15_unsegmented", with_bars("m1", f'SELECT instrument, ts_ms, {_CLOSE} / nullif(lag({_CLOSE}, 5) OVER w, 0) - 1 AS return_5, CASE WHEN count(*) OVER v = 15 THEN avg({_CLOSE}) OVER v END AS sma_15 FROM b WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms), v AS (PARTITION BY instrument ORDER BY ts_ms ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)'), "return_5 sma_15")
def _(spark, d):
    r = features.Rolling(segmented=False)
    rows = segments.in_row_buckets(sub.minute_bars(spark, d), 15, segments.BUCKET_BARS * MINUTE)
    return rows.select("instrument", "ts_ms", "own", C.change(F.col("close"), r.lag("close", 5)).alias("return_5"), r.mean("close", 15).alias("sma_15")).where("own").drop("own")


# targets and labels
@query("l02_horizon_returns", with_bars("h1", f'SELECT instrument, ts_ms, {", ".join(TARGETS)} FROM f WHERE {_ANY_TARGET}', *feature_ctes(HOUR)), " ".join(TARGETS))
def _(spark, d):
    rows = features.windows(sub.hour_bars(spark, d), HOUR, lambda r: features.future_returns(r, HOUR), 0, 60)
    return rows.dropna(how="all", subset=list(TARGETS)).select("instrument", "ts_ms", *TARGETS)


@query("l04_deadzone", with_bars("h1", "SELECT instrument, ts_ms, CASE WHEN future_return_5m IS NULL THEN NULL WHEN future_return_5m < -0.2::DOUBLE THEN 0 WHEN future_return_5m > 0.2::DOUBLE THEN 2 ELSE 1 END AS target FROM f", *feature_ctes(HOUR)))
def _(spark, d):
    rows = features.windows(sub.hour_bars(spark, d), HOUR, lambda r: features.future_returns(r, HOUR), 0, 60)
    return rows.select("instrument", "ts_ms", C.deadzone(F.col("future_return_5m"), 0.2).alias("target"))


_DIRECTION = f"""SELECT instrument, ts_ms, CASE WHEN ok THEN CAST(later > "close" AS INT) ELSE -1 END AS direction, CASE WHEN ok THEN later_ms END AS exit_ms FROM
 (SELECT *, lead("close", 5) OVER w AS later, lead(ts_ms, 5) OVER w AS later_ms, coalesce(lead(ts_ms, 5) OVER w - ts_ms = 5 * {HOUR} AND run_length < 3 AND lead(run_length, 5) OVER w < 3, false) AS ok FROM r WINDOW w AS (PARTITION BY instrument, segment ORDER BY ts_ms))"""


@query("l03_direction", with_bars("hq", _DIRECTION, *_runs_sql(False)))
def _(spark, d):
    masked = segments.closed_mask(_runs(spark, d), 3).select(*OHLC, "closed")
    return barriers.direction(masked, HOUR, 5).select("instrument", "ts_ms", "direction", "exit_ms")


def touch_ctes(configs: str, source: str = "s") -> tuple[str, ...]:
    """CTE t: for each bar of source (with segment) and row (key, width, horizon) of configs: label, hit, exit_ms, exit_close. width may be NULL."""
    return (
        f"n AS (SELECT *, row_number() OVER (PARTITION BY instrument, segment ORDER BY ts_ms) AS rn, count(*) OVER (PARTITION BY instrument, segment) AS size FROM {source})",
        f"e AS (SELECT n.*, c.* FROM n, LATERAL ({configs}) c)",
        "h AS (SELECT e.instrument, e.segment, e.rn, e.key, e.horizon, min(x.rn) AS at FROM e JOIN n x ON x.instrument = e.instrument AND x.segment = e.segment AND x.rn > e.rn AND x.rn <= e.rn + e.horizon AND (x.high >= e.\"close\" * (1 + e.width) OR x.low <= e.\"close\" * (1 - e.width)) GROUP BY ALL)",
        """t AS (SELECT e.*, CASE WHEN NOT ok THEN -2 WHEN h.at IS NULL THEN 1 WHEN x.high >= e."close" * (1 + e.width) AND x.low <= e."close" * (1 - e.width) THEN -1 WHEN x.high >= e."close" * (1 + e.width) THEN 2 ELSE 0 END AS label,
            CASE WHEN NOT ok THEN -1 WHEN h.at IS NULL THEN 1 WHEN x.high >= e."close" * (1 + e.width) AND x.low <= e."close" * (1 - e.width) THEN 3 WHEN x.high >= e."close" * (1 + e.width) THEN 2 ELSE 0 END AS hit,
            CASE WHEN ok THEN x.ts_ms END AS exit_ms, CASE WHEN ok THEN x."close" END AS exit_close
          FROM (SELECT *, rn + horizon <= size AND width IS NOT NULL AS ok FROM e) e LEFT JOIN h USING (instrument, segment, rn, key, horizon)
          LEFT JOIN n x ON x.instrument = e.instrument AND x.segment = e.segment AND x.rn = coalesce(h.at, e.rn + e.horizon))""",
    )


_CONFIGS = [(0.5, 5), (0.9, 5), (0.5, 15), (0.9, 15)]
_CONFIG_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {w}::DOUBLE, {h})" for i, (w, h) in enumerate(_CONFIGS)) + ") v(key, width, horizon)"


@query("l05_triple_barrier_sweep", with_bars("h1", 'SELECT instrument, ts_ms, width, horizon, label, hit, exit_ms, exit_close, (exit_ms - ts_ms) / 60000.0::DOUBLE AS elapsed FROM t', seg(HOUR), *touch_ctes(_CONFIG_SQL)), "width exit_close elapsed")
def _(spark, d):
    return barriers.triple_barrier(sub.hour_bars(spark, d), HOUR, _CONFIGS).select("instrument", "ts_ms", "width", "horizon", "label", "hit", "exit_ms", "exit_close", "elapsed")


_MULTIPLIERS = (0.1, 0.25)


def dynamic_ctes(step: int, source: str = "b", horizon: int = 60, lookback: int = 60) -> tuple[str, ...]:
    over = f"OVER (PARTITION BY instrument, segment ORDER BY ts_ms ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    configs = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {m}::DOUBLE)" for i, m in enumerate(_MULTIPLIERS)) + ") v(key, multiplier)"
    configs = f"SELECT key, multiplier, multiplier * CASE WHEN volatility > 0 THEN volatility END * sqrt({horizon}.0::DOUBLE) AS width, {horizon} AS horizon FROM ({configs})"
    return (
        seg(step, source, "s0"),
        f'l AS (SELECT *, CASE WHEN "close" > 0 AND {_lag(_CLOSE, 1)} > 0 THEN ln("close" / {_lag(_CLOSE, 1)}) END AS lr FROM s0)',
        f"sv AS (SELECT *, CASE WHEN count(lr) {over} = {lookback} THEN stddev_samp(lr) {over} END AS volatility FROM l)",
        *touch_ctes(configs, "sv"),
    )


_DYN = "SELECT instrument, ts_ms, multiplier, volatility, width, label, hit, exit_ms, exit_close FROM t"


@query("l07_dynamic_barrier", with_bars("d1", _DYN, *dynamic_ctes(DAY)), "multiplier volatility width exit_close")
def _(spark, d):
    return barriers.dynamic_barrier(sub.day_bars(spark, d), DAY, _MULTIPLIERS).select("instrument", "ts_ms", "multiplier", "volatility", "width", "label", "hit", "exit_ms", "exit_close")


def _masked(spark, d):
    return segments.closed_mask(_runs(spark, d), 3)


@query("l08_session_barrier", with_bars("hq", _DYN + " UNION ALL SELECT instrument, ts_ms, m, NULL, NULL, -3, -1, NULL, NULL FROM r, (VALUES (0.1::DOUBLE), (0.25::DOUBLE)) v(m) WHERE run_length >= 3", *_runs_sql(False), _ACTIVE, *dynamic_ctes(HOUR, "a", 5, 10)), "volatility multiplier width exit_close")
def _(spark, d):
    return barriers.session_barrier(_masked(spark, d), HOUR, _MULTIPLIERS, 5, 10).select("instrument", "ts_ms", "volatility", "multiplier", "width", "label", "hit", "exit_ms", "exit_close")


@query("l10_event_targets", with_bars("h1", "SELECT instrument, ts_ms, horizon, CASE WHEN label IN (0, 2) THEN 1 WHEN label = 1 THEN 0 END AS event, CASE WHEN label = 2 THEN 1 WHEN label = 0 THEN 0 END AS direction FROM t WHERE key IN (0, 2)", seg(HOUR), *touch_ctes(_CONFIG_SQL)))
def _(spark, d):
    rows = barriers.triple_barrier(sub.hour_bars(spark, d), HOUR, [(0.5, 5), (0.5, 15)])
    return rows.select("instrument", "ts_ms", "horizon", barriers.event_target(F.col("label")).alias("event"), barriers.direction_target(F.col("label")).alias("direction"))


_REASONS = """q AS (SELECT *, CASE WHEN "close" <= 0 THEN 'bad_price' WHEN lag(ts_ms, 61) OVER w IS NULL OR lead(ts_ms, 60) OVER w IS NULL THEN 'structural' WHEN coalesce(volatility, 0) <= 0 THEN 'zero_volatility' ELSE 'usable' END AS reason
 FROM sv WINDOW w AS (PARTITION BY instrument, segment ORDER BY ts_ms))"""


@query("l11_invalid_reasons", with_bars("d1", "SELECT CAST(year(make_timestamp(ts_ms * 1000)) AS INT) AS year, reason, count(*) AS n FROM q GROUP BY 1, 2", *dynamic_ctes(DAY)[:3], _REASONS))
def _(spark, d):
    return diagnostics.reason_counts(barriers.invalid_reasons(sub.day_bars(spark, d), DAY))


_COUNTS = ", ".join(f"count(*) FILTER (label = {v}) AS n_{k}" for k, v in diagnostics.CODES.items())
_PCTS = ", ".join(f"100.0::DOUBLE * count(*) FILTER (label = {v}) / nullif(count(*) FILTER (label IN (0, 1, 2)), 0) AS {k}_pct" for k, v in diagnostics.CODES.items() if v >= 0)
_YEARLY = f"SELECT multiplier, CAST(year(make_timestamp(ts_ms * 1000)) AS INT) AS year, count(*) AS n_rows, count(*) FILTER (label IN (0, 1, 2)) AS n_valid, {_COUNTS}, {_PCTS} FROM t GROUP BY 1, 2"


def _yearly(spark, d):
    return diagnostics.label_counts(diagnostics.with_year(barriers.dynamic_barrier(sub.day_bars(spark, d), DAY, _MULTIPLIERS)), ["multiplier", "year"])


@query("a02_labels_by_year", with_bars("d1", _YEARLY, *dynamic_ctes(DAY)), "multiplier short_pct timeout_pct long_pct")
def _(spark, d):
    return _yearly(spark, d)


@query("a03_label_stability", with_bars("d1", "SELECT multiplier, " + ", ".join(f"{f}({c}_pct) AS {c}_pct_{n}" for c in ("short", "timeout", "long") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"))) + f" FROM ({_YEARLY}) GROUP BY 1", *dynamic_ctes(DAY)),
       "multiplier " + " ".join(f"{c}_pct_{n}" for c in ("short", "timeout", "long") for n in ("mean", "std", "min")))
def _(spark, d):
    return diagnostics.stability(_yearly(spark, d), [f"{c}_pct" for c in ("short", "timeout", "long")], ["multiplier"])


@query("a04_label_summary", with_bars("d1", f"SELECT multiplier, count(*) AS n_rows, count(*) FILTER (label IN (0, 1, 2)) AS n_valid, {_COUNTS}, {_PCTS} FROM t GROUP BY 1", *dynamic_ctes(DAY)), "multiplier short_pct timeout_pct long_pct")
def _(spark, d):
    return diagnostics.label_counts(barriers.dynamic_barrier(sub.day_bars(spark, d), DAY, _MULTIPLIERS), ["multiplier"])


@query("segment_overview", with_bars("h1", f"""SELECT instrument, CAST(segment AS BIGINT) AS segment, count(*) AS n_bars, min(ts_ms) AS first_ms, count(return_1m) AS n_returns, count(volatility_15m) AS n_volatility, count(future_return_5m) AS n_targets,
 avg(return_1m) AS mean_return, max(volatility_15m) AS max_volatility FROM f GROUP BY 1, 2""", *feature_ctes(HOUR)), "mean_return max_volatility")
def _(spark, d):
    """Hourly bars, their continuous segments, and how many bars of each have returns, volatility and a target."""
    bars = segments.gap_segments(sub.hour_bars(spark, d), HOUR)
    first = lambda r: {"return_1m": C.change(F.col("close"), r.lag("close", 1))} | features.future_returns(r, HOUR, (5,))
    rows = features.windows(features.windows(bars, HOUR, first, 1, 5), HOUR, lambda r: {"volatility_15m": r.std("return_1m", 15)}, 15)
    return rows.groupBy("instrument", "segment").agg(
        F.count("*").alias("n_bars"), F.min("ts_ms").alias("first_ms"), F.count("return_1m").alias("n_returns"), F.count("volatility_15m").alias("n_volatility"), F.count("future_return_5m").alias("n_targets"),
        F.avg("return_1m").alias("mean_return"), F.max("volatility_15m").alias("max_volatility"),
    )
