"""Queries over several series, folds, scores and trades, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaymark.functions import columns as C
from quaymark.operators import align, barriers, boosting, diagnostics, features, metrics, ml, nested, quality, segments, simulate, splits
from quaymark.operators.features import FEATURES
from quaymark.sources import tables as src
from quaymark.streaming import bars as streaming

from . import substrate as sub
from .bar_queries import _AUDIT, _CONFIG_SQL, _INDEX, _YEARLY, DAY, HOUR, PRICES, _yearly, dynamic_ctes, feature_ctes, query, touch_ctes
from .substrate import SQL, with_bars
from .substrate import segments as seg

_O1 = f"o AS ({SQL['o1']})"
_YEAR = "CAST(year(make_timestamp(ts_ms * 1000)) AS INT)"


# joins
@query("j01_combined", with_bars("d1", 'SELECT b.instrument, b.ts_ms, b."open", b.high, b.low, b."close", o.instrument AS instrument_usd, o."open" AS open_usd, o.high AS high_usd, o.low AS low_usd, o."close" AS close_usd FROM b JOIN o USING (ts_ms)', _O1),
       PRICES + " open_usd high_usd low_usd close_usd")
def _(spark, d):
    return align.combined(sub.day_bars(spark, d), sub.order_day_bars(spark, d))


@query("j03_one_to_one", with_bars("d1", 'SELECT b.ts_ms, b."close", o."close" AS other FROM b LEFT JOIN o USING (ts_ms)', _O1), "close other")
def _(spark, d):
    other = sub.order_day_bars(spark, d).select("ts_ms", F.col("close").alias("other"))
    return align.one_to_one(sub.day_bars(spark, d).select("ts_ms", "close"), other, ["ts_ms"])


@query("j04_coverage", with_bars("d1", f"SELECT {_YEAR} AS year, count(*) AS n_rows, count(o.x) AS n_matched, 100.0::DOUBLE * count(o.x) / count(*) AS matched_pct FROM b LEFT JOIN (SELECT ts_ms, 1 AS x FROM o) o USING (ts_ms) GROUP BY 1", _O1), "matched_pct")
def _(spark, d):
    return align.coverage(sub.day_bars(spark, d), sub.order_day_bars(spark, d))


@query("j07_looked_up", with_bars("d1", 'SELECT b.ts_ms, o."close" AS other FROM b JOIN o USING (ts_ms)', _O1), "other")
def _(spark, d):
    return align.looked_up(sub.day_bars(spark, d).select("ts_ms"), sub.order_day_bars(spark, d).select("ts_ms", F.col("close").alias("other")), ["ts_ms"], strict=False)


@query("j08_by_position", with_bars("h1", 'SELECT p.instrument, p.ts_ms, p.target, q.ts_ms AS exit_ts_ms, q."close" AS exit_close FROM (SELECT *, position + 5 AS target FROM n) p LEFT JOIN n q ON q.instrument = p.instrument AND q.position = p.target', "n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) - 1 AS position FROM b)"), "exit_close")
def _(spark, d):
    w = Window.partitionBy("instrument").orderBy("ts_ms")
    rows = sub.hour_bars(spark, d).withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    return align.by_position(rows.withColumn("target", F.col("position") + 5), "target", ["ts_ms", "close"]).select("instrument", "ts_ms", "target", "exit_ts_ms", "exit_close")


@query("j09_alignment", with_bars("h1", """SELECT count(*) AS n_rows, count(l.key) AS n_matched, count(*) - count(l.key) AS n_missing, count(*) FILTER (label = 0) AS n_short, count(*) FILTER (label = 1) AS n_timeout, count(*) FILTER (label = 2) AS n_long,
 count(*) FILTER (label = -1) AS n_ambiguous, count(*) FILTER (label = -2) AS n_invalid, count(*) FILTER (label = -3) AS n_closed FROM b LEFT JOIN (SELECT * FROM t WHERE key = 0 AND ts_ms % 7200000 = 0) l USING (instrument, ts_ms)""", seg(HOUR), *touch_ctes(_CONFIG_SQL)))
def _(spark, d):
    labels = barriers.triple_barrier(sub.hour_bars(spark, d), HOUR, [(0.5, 5)]).where(F.col("ts_ms") % 7_200_000 == 0)
    return align.alignment(sub.hour_bars(spark, d), labels, ["instrument", "ts_ms"])


@query("j10_reverified", with_bars("h1", f"""SELECT count(official) AS n_compared, count(*) - count(official) AS n_missing, count(*) FILTER (abs(future_return_15m - official) > 1e-12::DOUBLE) AS n_mismatched, max(abs(future_return_15m - official)) AS max_difference
 FROM (SELECT *, CASE WHEN ts_ms % {7 * HOUR} <> 0 THEN future_return_15m + CASE WHEN ts_ms % {5 * HOUR} = 0 THEN 0.25::DOUBLE ELSE 0 END END AS official FROM f WHERE future_return_15m IS NOT NULL)""", *feature_ctes(HOUR)), "max_difference")
def _(spark, d):
    """The official values lack every seventh hour and are off in every fifth."""
    bars = sub.hour_bars(spark, d)
    windowed = features.windows(bars, HOUR, lambda r: features.future_returns(r, HOUR, (15,)), 0, 15).dropna(subset=["future_return_15m"])
    official = align.forward_by_time(bars, HOUR, 15).where(F.col("ts_ms") % (7 * HOUR) != 0)
    off = F.when(F.col("ts_ms") % (5 * HOUR) == 0, 0.25).otherwise(0.0)
    return align.reverified(windowed, official.withColumn("future_return_15m", F.col("future_return_15m") + off), ["instrument", "ts_ms"], "future_return_15m")


@query("j11_forward_by_time", with_bars("m1", 'SELECT b.instrument, b.ts_ms, x."close" / nullif(b."close", 0) - 1 AS future_return_5m FROM b JOIN b x ON x.instrument = b.instrument AND x.ts_ms = b.ts_ms + 300000'), "future_return_5m")
def _(spark, d):
    return align.forward_by_time(sub.minute_bars(spark, d), src.MINUTE, 5)


@query("jx_as_of", with_bars("m1", 'SELECT b.instrument, b.ts_ms, h.ts_ms AS r_ms, h."close" AS r_close FROM b ASOF LEFT JOIN h ON h.ts_ms <= b.ts_ms', f"h AS ({SQL['h1']})").replace("SELECT b.instrument, b.ts_ms, h.ts_ms AS r_ms", "SELECT b.instrument, b.ts_ms, h.ts_ms AS r_ms"), "r_close")
def _(spark, d):
    left = sub.minute_bars(spark, d).select("instrument", "ts_ms")
    return align.as_of(left, sub.hour_bars(spark, d), ["close"], 86_400_000)


# folds
def _fold_rows(spark, d):
    table = splits.folds(spark, [1998, 1999, 2000, 2001], 1995)
    return splits.in_folds(sub.day_bars(spark, d), table)


_FOLDS = """folds AS (SELECT y AS fold, epoch_ms(make_timestamp(1995, 1, 1, 0, 0, 0)) AS train_start, epoch_ms(make_timestamp(y, 1, 1, 0, 0, 0)) - 3660000 AS train_end, epoch_ms(make_timestamp(y, 1, 1, 0, 0, 0)) + 28800000 AS valid_start,
 epoch_ms(make_timestamp(y + 1, 1, 1, 0, 0, 0)) AS valid_end FROM (VALUES (1998), (1999), (2000), (2001)) v(y)),
 fr AS (SELECT b.*, fold, valid_start, CASE WHEN ts_ms BETWEEN train_start AND train_end THEN 'train' ELSE 'valid' END AS part FROM b JOIN folds ON ts_ms BETWEEN train_start AND train_end OR (ts_ms >= valid_start AND ts_ms < valid_end))"""


@query("g01_folds", with_bars("d1", "SELECT fold, part, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM fr GROUP BY 1, 2", _FOLDS))
def _(spark, d):
    return _fold_rows(spark, d).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query("g04_purged_by_label_end", with_bars("d1", f"SELECT fold, part, count(*) AS n, max(ts_ms) AS last_ms FROM fr WHERE part = 'valid' OR ts_ms + 60 * {DAY}::BIGINT < valid_start GROUP BY 1, 2", _FOLDS))
def _(spark, d):
    return splits.purged(_fold_rows(spark, d), F.col("ts_ms") + 60 * DAY).groupBy("fold", "part").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))


@query("g05_purged_by_minutes", with_bars("d1", "SELECT fold, part, count(*) AS n FROM fr WHERE part = 'valid' OR ts_ms < valid_start - 86400 * 60000::BIGINT GROUP BY 1, 2", _FOLDS))
def _(spark, d):
    return splits.purged(_fold_rows(spark, d), minutes=86_400).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query("t09_stride_after_filter", with_bars("h1", 'SELECT instrument, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) - 1 AS n FROM b WHERE "close" > 50) WHERE n % 5 = 0'))
def _(spark, d):
    return splits.strided(sub.hour_bars(spark, d), 5, F.col("close") > 50).select("instrument", "ts_ms")


@query("t10_stride_before_filter", with_bars("h1", 'SELECT instrument, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts_ms) - 1 AS n FROM b) WHERE n % 5 = 0 AND "close" > 50'))
def _(spark, d):
    return splits.strided(sub.hour_bars(spark, d), 5, F.col("close") > 50, filter_first=False).select("instrument", "ts_ms")


@query("t11_hash_sample", with_bars("m1", f"SELECT instrument, ts_ms FROM b WHERE CAST('0x' || substr(md5('42:' || ts_ms), 1, 8) AS BIGINT) < {int(0.1 * (1 << 32))}"))
def _(spark, d):
    return splits.hash_sample(sub.minute_bars(spark, d), 0.1).select("instrument", "ts_ms")


@query("a16_split_counts", with_bars("d1", " ".join("SELECT count(*) FILTER (y < 1999) AS n_train, count(*) FILTER (y = 1999) AS n_valid, count(*) FILTER (y = 2000) AS n_test, count(*) FILTER (y > 2000) AS n_outside FROM (SELECT year(make_timestamp(ts_ms * 1000)) AS y FROM b)".split())))
def _(spark, d):
    start = lambda y: F.unix_millis(F.lit(f"{y}-01-01 00:00:00").cast("timestamp"))
    return splits.split_counts(sub.day_bars(spark, d), start(1999), start(2000), start(2001))


# scores: deterministic predictions from a feature, so that every metric can be checked
_SCORES = """sc AS (SELECT instrument, ts_ms, future_return_5m AS y, return_5m * -0.3::DOUBLE AS p, CAST(future_return_5m > 0 AS INT) AS up, round(1 / (1 + exp(return_1m)), 3) AS prob,
 CASE WHEN future_return_5m < -0.2::DOUBLE THEN 0 WHEN future_return_5m > 0.2::DOUBLE THEN 2 ELSE 1 END AS cls, CASE WHEN -return_1m < -0.3::DOUBLE THEN 0 WHEN -return_1m > 0.3::DOUBLE THEN 2 ELSE 1 END AS called
 FROM f WHERE future_return_5m IS NOT NULL AND return_5m IS NOT NULL)"""


def _scores(spark, d):
    rows = features.windows(sub.hour_bars_by_type(spark, d), HOUR, lambda r: features.returns(r) | features.future_returns(r, HOUR, (5,)), 61, 60)
    rows = rows.dropna(subset=["future_return_5m", "return_5m"])
    prob = F.round(1 / (1 + F.exp("return_1m")), 3)
    return rows.select(
        "instrument", "ts_ms", F.col("future_return_5m").alias("y"), (F.col("return_5m") * -0.3).alias("p"), (F.col("future_return_5m") > 0).cast("int").alias("up"), prob.alias("prob"),
        C.deadzone(F.col("future_return_5m"), 0.2).alias("cls"), C.deadzone(-F.col("return_1m"), 0.3).alias("called"),
    )


def _score_sql(select: str) -> str:
    return with_bars("ht", select, *feature_ctes(HOUR), _SCORES)


_REGRESSION = """SELECT instrument, count(*) AS n, avg((p - y) * (p - y)) AS mse, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, avg(y * y) AS zero_mse, var_pop(y) AS mean_mse, 100 * (1 - avg((p - y) * (p - y)) / nullif(avg(y * y), 0)) AS improvement_pct,
 CASE WHEN stddev_pop(y) > 0 AND stddev_pop(p) > 0 THEN corr(y, p) END AS correlation, avg(CAST(sign(p) = sign(y) AS INT)) AS direction, avg(CASE WHEN y <> 0 THEN CAST(sign(p) = sign(y) AS INT) END) AS direction_moved, avg(CASE WHEN p <> 0 THEN CAST(sign(p) = sign(y) AS INT) END) AS direction_called FROM sc GROUP BY 1"""


@query("x01_regression", _score_sql(_REGRESSION), "mse rmse mae zero_mse mean_mse improvement_pct correlation direction direction_moved direction_called", 4)
def _(spark, d):
    return metrics.regression(_scores(spark, d), ["instrument"])


@query("x04_summary", _score_sql("SELECT instrument, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.5) AS q50, quantile_cont(p, 0.75) AS q75, max(p) AS max FROM sc GROUP BY 1"), "mean std min q25 q50 q75 max")
def _(spark, d):
    return metrics.summary(_scores(spark, d), "p", ["instrument"])


_PCT = ", ".join(f"quantile_cont(y, {x / 100}) AS p{x}" for x in (1, 5, 10, 25, 50, 75, 90, 95, 99))


@query("a11_distribution", _score_sql(f"SELECT instrument, count(y) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, max(y) AS max, 100.0::DOUBLE * avg(CAST(y > 0 AS INT)) AS up_pct, 100.0::DOUBLE * avg(CAST(y < 0 AS INT)) AS down_pct, 100.0::DOUBLE * avg(CAST(y = 0 AS INT)) AS flat_pct, {_PCT} FROM sc GROUP BY 1"),
       "mean std min max up_pct down_pct flat_pct p1 p5 p10 p25 p50 p75 p90 p95 p99", 5)
def _(spark, d):
    return metrics.distribution(_scores(spark, d), "y", ["instrument"])


@query("x05_confusion", _score_sql("SELECT g.instrument, y.k AS y, p.k AS p, count(sc.ts_ms) AS n FROM (SELECT DISTINCT instrument FROM sc) g CROSS JOIN (VALUES (0), (1), (2)) y(k) CROSS JOIN (VALUES (0), (1), (2)) p(k) LEFT JOIN sc ON sc.instrument = g.instrument AND sc.cls = y.k AND sc.called = p.k GROUP BY ALL"))
def _(spark, d):
    rows = _scores(spark, d).select("instrument", F.col("cls").alias("y"), F.col("called").alias("p"))
    return metrics.confusion(rows, [0, 1, 2], ["instrument"])


def _class_sql() -> str:
    tp = lambda k: f"count(*) FILTER (cls = {k} AND called = {k})"
    true, called = (lambda k: f"count(*) FILTER (cls = {k})"), (lambda k: f"count(*) FILTER (called = {k})")
    cells = []
    for k in range(3):
        cells += [f"coalesce({tp(k)} / nullif({called(k)}, 0), 0)::DOUBLE AS precision_{k}", f"coalesce({tp(k)} / nullif({true(k)}, 0), 0)::DOUBLE AS recall_{k}", f"coalesce(2 * {tp(k)} / nullif({true(k)} + {called(k)}, 0), 0)::DOUBLE AS f1_{k}"]
    inner = f"SELECT instrument, count(*) AS n, avg(CAST(cls = called AS INT)) AS accuracy, {', '.join(cells)}, {', '.join(f'CAST({true(k)} > 0 AS INT) AS h{k}' for k in range(3))} FROM sc GROUP BY 1"
    return _score_sql(f"SELECT * EXCLUDE (h0, h1, h2), (f1_0 + f1_1 + f1_2) / 3 AS macro_f1, (recall_0 + recall_1 + recall_2) / nullif(h0 + h1 + h2, 0) AS balanced_accuracy FROM ({inner})")


@query("x07_classification", _class_sql(), "accuracy macro_f1 balanced_accuracy " + " ".join(f"{m}_{k}" for m in ("precision", "recall", "f1") for k in range(3)))
def _(spark, d):
    return metrics.classification(_scores(spark, d).select("instrument", F.col("cls").alias("y"), F.col("called").alias("p")), [0, 1, 2], ["instrument"])


@query("x08_coverage", _score_sql("SELECT instrument, avg(CAST(called <> 1 AS INT)) AS coverage, avg(CASE WHEN called <> 1 AND cls <> 1 THEN CAST(cls = called AS INT) END) AS direction FROM sc GROUP BY 1"), "coverage direction")
def _(spark, d):
    return metrics.coverage(_scores(spark, d).select("instrument", F.col("cls").alias("y"), F.col("called").alias("p")), 1, ["instrument"])


def _binary(spark, d):
    return _scores(spark, d).select("instrument", F.col("up").alias("y"), F.col("prob").alias("p"))


_AUC = """SELECT instrument, (sum(CASE WHEN up = 1 THEN r END) - count(*) FILTER (up = 1) * (count(*) FILTER (up = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (up = 1) * count(*) FILTER (up = 0), 0) AS auc, count(*) FILTER (up = 1) AS n_pos, count(*) FILTER (up = 0) AS n_neg
 FROM (SELECT *, rank() OVER (PARTITION BY instrument ORDER BY prob) + (count(*) OVER (PARTITION BY instrument, prob) - 1) / 2.0::DOUBLE AS r FROM sc) GROUP BY 1"""


@query("x09_roc_auc", _score_sql(_AUC), "auc")
def _(spark, d):
    return metrics.roc_auc(_binary(spark, d), ["instrument"]).withColumns({c: F.col(c).cast("long") for c in ("n_pos", "n_neg")})


@query("x10_average_precision", _score_sql("SELECT instrument, sum(pos * tp / n) / nullif(sum(pos), 0) AS average_precision FROM (SELECT instrument, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM (SELECT instrument, prob, CAST(sum(up) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY 1, 2) WINDOW w AS (PARTITION BY instrument ORDER BY prob DESC)) GROUP BY 1"), "average_precision")
def _(spark, d):
    return metrics.average_precision(_binary(spark, d), ["instrument"])


@query("x11_brier", _score_sql("SELECT instrument, CAST(sum(CAST((prob - up) * (prob - up) AS DECIMAL(26,12))) AS DOUBLE) / count(prob) AS brier FROM sc GROUP BY 1"), "brier")
def _(spark, d):
    return metrics.brier(_binary(spark, d), ["instrument"])


_EDGES = " + ".join(f"CAST(prob >= {i}::DOUBLE * 0.1::DOUBLE AS INT)" for i in range(1, 10))


@query("x12_calibration", _score_sql(f"SELECT instrument, {_EDGES} AS bin, count(*) AS n, CAST(sum(CAST(prob AS DECIMAL(20,9))) AS DOUBLE) / count(prob) AS mean_p, avg(up) AS rate FROM sc GROUP BY 1, 2"), "mean_p rate")
def _(spark, d):
    return metrics.calibration(_binary(spark, d), ["instrument"])


_PICKED = [c for c in FEATURES if c.startswith(("return", "momentum", "body", "candle", "upper", "lower"))]


def _labelled(spark, d):
    rows = features.with_features(segments.local_segments(segments.in_buckets(sub.hour_bars_by_type(spark, d), HOUR, 480, 60), HOUR)).withColumns(features.future_returns(features.Rolling(), HOUR, (5,)))
    return rows.where("own").dropna(subset=["future_return_5m"]).withColumn("y", (F.col("future_return_5m") > 0).cast("int"))


def _feature_auc_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS p, CAST(future_return_5m > 0 AS INT) AS up FROM f WHERE future_return_5m IS NOT NULL AND {c} IS NOT NULL" for c in _PICKED)
    return with_bars("ht", """SELECT *, abs(auc - 0.5) AS advantage, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign FROM (SELECT feature, (sum(CASE WHEN up = 1 THEN r END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS auc, n1 AS n_pos, n0 AS n_neg FROM
 (SELECT *, count(*) FILTER (up = 1) OVER (PARTITION BY feature) AS n1, count(*) FILTER (up = 0) OVER (PARTITION BY feature) AS n0, rank() OVER (PARTITION BY feature ORDER BY p) + (count(*) OVER (PARTITION BY feature, p) - 1) / 2.0::DOUBLE AS r FROM lg) GROUP BY feature, n1, n0)
 WHERE n_pos + n_neg >= 100 AND n_pos > 0 AND n_neg > 0""", *feature_ctes(HOUR), f"lg AS ({cells})")


@query("m06_feature_auc", _feature_auc_sql(), "auc advantage")
def _(spark, d):
    return metrics.feature_auc(_labelled(spark, d), _PICKED)


@query("m06_top_features", f"SELECT *, row_number() OVER (ORDER BY advantage DESC, feature) AS place FROM ({_feature_auc_sql()}) QUALIFY place <= 5", "auc advantage")
def _(spark, d):
    return metrics.top_features(metrics.feature_auc(_labelled(spark, d), _PICKED), 5).withColumn("place", F.col("place").cast("long"))


@query("m05_scaled", with_bars("d1", f"""SELECT ts_ms, (body - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END AS body, (candle_range - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END AS candle_range FROM f,
 (SELECT avg(body) AS m1, stddev_pop(body) AS s1, avg(candle_range) AS m2, stddev_pop(candle_range) AS s2 FROM f WHERE {_YEAR} < 1999)""", *feature_ctes(DAY)), "body candle_range")
def _(spark, d):
    rows = sub.day_bars(spark, d).withColumns(features.candle()).select("ts_ms", "body", "candle_range")
    fitted = metrics.scaler(diagnostics.with_year(rows).where("year < 1999"), ["body", "candle_range"])
    return metrics.scaled(rows, fitted, ["body", "candle_range"])


# trades
_THRESHOLDS, _COSTS = (0.2, 0.5, 0.8), (0.0, 1.0, 2.0, 5.0)


def _walk_sql(signals: str, keys: list[str], again: str = ">=") -> str:
    """Recursive CTE walk: each group's trades; the next begins at the first signal at or after the exit."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = w.{c}" for c in keys)
    return f"""sg AS ({signals}), walk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts_ms) AS pick FROM sg) WHERE pick = 1
 UNION ALL SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY {", ".join("s." + c for c in keys)} ORDER BY s.ts_ms) AS pick FROM walk w JOIN sg s ON {on} AND s.ts_ms {again} w.exit_ms) WHERE pick = 1)"""


_SIGNALS = f"""SELECT instrument, threshold, ts_ms, ts_ms + 5 * {HOUR}::BIGINT AS exit_ms, CASE WHEN p > threshold THEN 1 ELSE -1 END AS side, y FROM sc, (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) v(threshold) WHERE p > threshold OR p < -threshold"""


def _trades(spark, d):
    signals = simulate.threshold_signals(_scores(spark, d).withColumn("exit_ms", F.col("ts_ms") + 5 * HOUR), "p", _THRESHOLDS)
    signals = signals.select("instrument", "threshold", "ts_ms", "exit_ms", "side", "y")
    return simulate.non_overlapping(signals, ["instrument", "threshold"]).withColumn("gross", F.col("side") * F.col("y"))


def _recursive(text: str) -> str:
    return text.replace("WITH b AS", "WITH RECURSIVE b AS", 1)


@query("b01_horizon_trades", _recursive(with_bars("ht", "SELECT instrument, threshold, ts_ms, exit_ms, side, y, side * y AS gross FROM walk", *feature_ctes(HOUR), _SCORES, _walk_sql(_SIGNALS, ["instrument", "threshold"]))), "threshold y gross")
def _(spark, d):
    return _trades(spark, d)


def _equity_sql(trades: str, keys: list[str]) -> str:
    """Statistics as equity(): a product over the trades in order of time."""
    k = ", ".join(keys)
    return f"""SELECT {k}, count(*) AS trades, count(*) FILTER (side > 0) AS longs, count(*) FILTER (side < 0) AS shorts, sum(gross) AS gross_sum, sum(net) AS net_sum, arg_max(e, ts_ms) - 1 AS compound_return, avg(CAST(net > 0 AS INT)) AS win_rate,
 CASE WHEN sum(CASE WHEN net < 0 THEN -net ELSE 0 END) > 0 THEN sum(CASE WHEN net > 0 THEN net ELSE 0 END) / sum(CASE WHEN net < 0 THEN -net ELSE 0 END) END AS profit_factor, min(e / nullif(top, 0) - 1) AS max_drawdown, avg(net) AS avg_trade_net
 FROM (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY ts_ms) AS top FROM (SELECT *, product(1 + net) OVER (PARTITION BY {k} ORDER BY ts_ms) AS e FROM ({trades}))) GROUP BY {k}"""


_STATS = "gross_sum net_sum compound_return win_rate profit_factor max_drawdown avg_trade_net"
_SMALL = "SELECT instrument, threshold, cost_bps, ts_ms, side, side * y * 0.01::DOUBLE AS gross, side * y * 0.01::DOUBLE - cost_bps / 10000.0::DOUBLE AS net FROM walk, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) c(cost_bps)"


def _grid(spark, d):
    trades = _trades(spark, d).withColumn("gross", F.col("gross") * 0.01)
    return simulate.equity(simulate.with_costs(trades, _COSTS), ["instrument", "threshold", "cost_bps"])


_GRID_SQL = _recursive(with_bars("ht", _equity_sql(_SMALL, ["instrument", "threshold", "cost_bps"]), *feature_ctes(HOUR), _SCORES, _walk_sql(_SIGNALS, ["instrument", "threshold"])))


@query("b07_cost_grid", _GRID_SQL, "threshold cost_bps " + _STATS)
def _(spark, d):
    return _grid(spark, d)


@query("a08_rollup", f"SELECT threshold, cost_bps, count(*) AS n, sum(net_sum) AS total, avg(net_sum) AS mean, median(net_sum) AS median, min(net_sum) AS min, max(net_sum) AS max FROM ({_GRID_SQL}) GROUP BY 1, 2", "threshold cost_bps total mean median min max")
def _(spark, d):
    return diagnostics.rollup(_grid(spark, d), ["threshold", "cost_bps"], "net_sum")


@query("g07_selected_threshold", f"SELECT instrument, cost_bps, threshold, trades, compound_return FROM ({_GRID_SQL}) WHERE trades >= 20 QUALIFY row_number() OVER (PARTITION BY instrument, cost_bps ORDER BY compound_return DESC, trades DESC, threshold) = 1", "cost_bps threshold compound_return")
def _(spark, d):
    best = splits.selected(_grid(spark, d), ["instrument", "cost_bps"], [F.desc("compound_return"), F.desc("trades"), F.col("threshold")], F.col("trades") >= 20)
    return best.select("instrument", "cost_bps", "threshold", "trades", "compound_return")


_BARRIER_SIGNALS = "SELECT t.instrument, t.key, t.ts_ms, t.exit_ms, t.label, t.width, t.\"close\" AS entry, t.exit_close, CASE WHEN t.\"close\" < t.\"open\" THEN 1 ELSE -1 END AS side FROM t WHERE label IN (0, 1, 2)"
_WIDTHS = [(0.3, 5), (0.6, 10)]
_WIDTH_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {w}::DOUBLE, {h})" for i, (w, h) in enumerate(_WIDTHS)) + ") v(key, width, horizon)"
_BARRIER_GROSS = "CASE WHEN label = 1 THEN CASE WHEN side > 0 THEN exit_close / nullif(entry, 0) - 1 ELSE entry / nullif(exit_close, 0) - 1 END WHEN (label = 2) = (side > 0) THEN width ELSE -width END"


def _barrier_trades(spark, d):
    rows = barriers.triple_barrier(sub.hour_bars(spark, d), HOUR, _WIDTHS).where("label in (0, 1, 2)")
    side = F.when(F.col("close") < F.col("open"), 1).otherwise(-1)
    signals = rows.select("instrument", "horizon", "ts_ms", "exit_ms", "label", "width", F.col("close").alias("entry"), "exit_close", side.alias("side"))
    trades = simulate.non_overlapping(signals, ["instrument", "horizon"], strict=True)
    return trades.withColumn("gross", simulate.barrier_gross(F.col("side"), F.col("label"), F.col("width"), F.col("entry"), F.col("exit_close")))


@query("b03_barrier_trades", _recursive(with_bars("h1", f"SELECT CASE key WHEN 0 THEN 5 ELSE 10 END AS horizon, ts_ms, exit_ms, label, side, {_BARRIER_GROSS} AS gross FROM walk", seg(HOUR), *touch_ctes(_WIDTH_SQL), _walk_sql(_BARRIER_SIGNALS, ["instrument", "key"], ">"))), "gross")
def _(spark, d):
    return _barrier_trades(spark, d).select("horizon", "ts_ms", "exit_ms", "label", "side", "gross")


_PAIR_SIGNALS = f"SELECT instrument, low, high, ts_ms, ts_ms + 5 * {HOUR}::BIGINT AS exit_ms, CASE WHEN prob >= high THEN 1 ELSE -1 END AS side, y FROM sc, (VALUES (0.45::DOUBLE, 0.55::DOUBLE), (0.3::DOUBLE, 0.6::DOUBLE)) v(low, high) WHERE prob >= high OR prob <= low"


@query("b05_probability_trades", _recursive(with_bars("ht", "SELECT instrument, low, high, count(*) AS trades, CAST(sum(side) AS BIGINT) AS net_side, sum(side * y) AS gross_sum FROM walk GROUP BY 1, 2, 3", *feature_ctes(HOUR), _SCORES, _walk_sql(_PAIR_SIGNALS, ["instrument", "low", "high"]))), "low high gross_sum", 4)
def _(spark, d):
    rows = _scores(spark, d).withColumn("exit_ms", F.col("ts_ms") + 5 * HOUR)
    signals = simulate.probability_signals(rows, "prob", [(0.45, 0.55), (0.3, 0.6)]).select("instrument", "low", "high", "ts_ms", "exit_ms", "side", "y")
    trades = simulate.non_overlapping(signals, ["instrument", "low", "high"])
    return trades.groupBy("instrument", "low", "high").agg(F.count("*").alias("trades"), F.sum("side").alias("net_side"), F.sum(F.col("side") * F.col("y")).alias("gross_sum"))


# models: trained here, so there is no SQL for them
def _train_parts(spark, d):
    rows = diagnostics.with_year(features.feature_set(sub.day_bars(spark, d), DAY)).dropna(subset=["future_return_5m"])
    rows = rows.withColumns({"up": (F.col("future_return_5m") > 0).cast("double"), "cls": C.deadzone(F.col("future_return_5m"), 0.05).cast("double")})
    # a model reads its rows many times: the bars are made from the table once
    rows = src.stored(rows, "model-rows")
    cut = rows.agg(F.expr("percentile_approx(ts_ms, 0.7)")).first()[0]
    return rows.where(F.col("ts_ms") <= cut - 5 * DAY), rows.where(F.col("ts_ms") > cut)


_FEW = ["return_1m", "return_5m", "distance_sma_15", "distance_sma_60", "volatility_15m", "body_range_ratio"]


@query("m01_boosted_regression")
def _(spark, d):
    """Boosting stops when the last seventh of the training rows gets no better."""
    train, valid = _train_parts(spark, d)
    edge = train.agg(F.expr("percentile_approx(ts_ms, 0.85)")).first()[0]
    model = ml.boosted_regression(train.withColumn("held", F.col("ts_ms") > edge), _FEW, "future_return_5m", 10, "held")
    return metrics.regression(ml.predicted(model, valid).withColumn("y", F.col("future_return_5m")))


@query("m02_forest")
def _(spark, d):
    train, valid = _train_parts(spark, d)
    rows = ml.predicted(ml.forest(train, _FEW, "cls"), valid)
    return metrics.classification(rows.select(F.col("cls").cast("int").alias("y"), F.col("p").cast("int").alias("p")), [0, 1, 2])


@query("m03_boosted_binary")
def _(spark, d):
    train, valid = _train_parts(spark, d)
    rows = ml.predicted(ml.boosted_binary(train, _FEW, "up", 10), valid)
    return metrics.roc_auc(rows.select(F.col("up").cast("int").alias("y"), F.col("probabilities")[1].alias("p")))


@query("m04_logistic")
def _(spark, d):
    train, valid = _train_parts(spark, d)
    fitted = metrics.scaler(train, _FEW)
    model = ml.logistic(metrics.scaled(train, fitted, _FEW), _FEW, "up")
    rows = ml.predicted(model, metrics.scaled(valid, fitted, _FEW))
    return metrics.roc_auc(rows.select(F.col("up").cast("int").alias("y"), F.col("probabilities")[1].alias("p")))


@query("r03_stream_bars", f"""SELECT ts_ms, "open", high, low, "close" FROM ({SQL['h1']}) WHERE ts_ms + {HOUR} <= (SELECT epoch_ms(max(ts)) FROM events) - 600000""", PRICES)
def _(spark, d):
    """Two calls over the same stream folder: the second finds nothing new, so nothing is emitted twice."""
    place = src.shared_folder(spark, "stream")
    events = streaming.read_events(spark, f"{d}/events[.]parquet", src.table(spark, d, "events").schema)
    bars = streaming.stream_bars(events, "1 hour")
    for _ in range(2):
        streaming.run_available(bars, f"{place}/bars", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/bars")


# further operators of the inventory, each over whole tables
@query("l01_single_horizon", with_bars("h1", 'SELECT instrument, ts_ms, r AS future_return_15m FROM (SELECT *, CASE WHEN lead(ts_ms, 15) OVER w - ts_ms = 15 * 3600000 THEN lead("close", 15) OVER w / nullif("close", 0) - 1 END AS r FROM b WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms)) WHERE r IS NOT NULL'), "future_return_15m")
def _(spark, d):
    rows = features.windows(sub.hour_bars(spark, d), HOUR, lambda r: features.future_returns(r, HOUR, (15,)), 0, 15)
    return rows.dropna(subset=["future_return_15m"]).select("instrument", "ts_ms", "future_return_15m")


@query("w17_log_returns", with_bars("d1", 'SELECT instrument, ts_ms, ln("close" / lag("close") OVER (PARTITION BY instrument, segment ORDER BY ts_ms)) AS log_return FROM s', seg(DAY)), "log_return")
def _(spark, d):
    return features.windows(sub.day_bars(spark, d), DAY, lambda r: {"log_return": F.log(C.ratio(F.col("close"), r.lag("close", 1)))}, 1).select("instrument", "ts_ms", "log_return")


@query("w12_rolling_sum", with_bars("h1", 'SELECT instrument, ts_ms, CASE WHEN count(*) OVER w = 10 THEN sum("close" - "open") OVER w END AS total FROM s WINDOW w AS (PARTITION BY instrument, segment ORDER BY ts_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', seg(HOUR)), "total")
def _(spark, d):
    rows = sub.hour_bars(spark, d).withColumn("body", F.col("close") - F.col("open"))
    return features.windows(rows, HOUR, lambda r: {"total": r.total("body", 10)}, 10).select("instrument", "ts_ms", "total")


@query("f03_calendar", with_bars("m1", f"""SELECT ts_ms, CAST(CAST(make_timestamp(ts_ms * 1000) AS DATE) AS VARCHAR) AS date, {_YEAR} AS year, CAST(isodow(make_timestamp(ts_ms * 1000)) - 1 AS INT) AS day_of_week, CAST(hour(make_timestamp(ts_ms * 1000)) AS INT) AS hour,
 CAST(minute(make_timestamp(ts_ms * 1000)) AS INT) AS minute, CAST(hour(make_timestamp(ts_ms * 1000)) BETWEEN 7 AND 15 AS INT) AS session_london, CAST(hour(make_timestamp(ts_ms * 1000)) BETWEEN 13 AND 20 AS INT) AS session_newyork,
 CAST(hour(make_timestamp(ts_ms * 1000)) BETWEEN 13 AND 15 AS INT) AS session_overlap FROM b"""))
def _(spark, d):
    return sub.minute_bars(spark, d).select("ts_ms", *[v.alias(k) for k, v in (C.calendar() | C.trading_sessions()).items()]).withColumn("date", F.col("date").cast("string"))


@query("p09_finite_rows", "SELECT o_orderkey, o_totalprice / nullif(o_custkey % 5, 0) AS ratio FROM orders WHERE o_custkey % 5 <> 0", "ratio")
def _(spark, d):
    rows = src.table(spark, d, "orders").select("o_orderkey", C.ratio(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("ratio"))
    return rows.where(C.all_finite("ratio"))


@query("p16_clipped", with_bars("h1", 'SELECT instrument, ts_ms, least(greatest("close", 20.0::DOUBLE), 80.0::DOUBLE) AS clipped FROM b'), "clipped")
def _(spark, d):
    return sub.hour_bars(spark, d).select("instrument", "ts_ms", C.clip(F.col("close"), 20.0, 80.0).alias("clipped"))


@query("f11_argmax", "SELECT event_id, CASE WHEN value >= event_id % 97 AND value >= event_id % 89 THEN 0 WHEN event_id % 97 >= event_id % 89 THEN 1 ELSE 2 END AS best FROM events")
def _(spark, d):
    scores = F.array(F.col("value"), (F.col("event_id") % 97).cast("double"), (F.col("event_id") % 89).cast("double"))
    return src.table(spark, d, "events").select("event_id", C.argmax(scores).alias("best"))


@query("t12_union", f"SELECT instrument, ts_ms FROM ({SQL['d1']}) UNION ALL SELECT instrument, ts_ms FROM ({SQL['o1']})")
def _(spark, d):
    return sub.day_bars(spark, d).unionByName(sub.order_day_bars(spark, d)).select("instrument", "ts_ms")


@query("t13_set_operations", f"SELECT ts_ms, 'both' AS side FROM (SELECT ts_ms FROM ({SQL['d1']}) INTERSECT SELECT ts_ms FROM ({SQL['o1']})) UNION ALL SELECT ts_ms, 'lines' FROM (SELECT ts_ms FROM ({SQL['d1']}) EXCEPT SELECT ts_ms FROM ({SQL['o1']}))")
def _(spark, d):
    a, b = sub.day_bars(spark, d).select("ts_ms"), sub.order_day_bars(spark, d).select("ts_ms")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("lines")))


@query("a13_value_counts", f"SELECT {_YEAR} AS year, o_orderstatus AS label, count(*) AS n FROM (SELECT epoch_ms(o_orderdate) AS ts_ms, o_orderstatus FROM orders) GROUP BY 1, 2")
def _(spark, d):
    rows = src.table(spark, d, "orders").select(C.epoch_ms("o_orderdate").alias("ts_ms"), F.col("o_orderstatus").alias("label"))
    return diagnostics.with_year(rows).groupBy("year", "label").agg(F.count("*").alias("n"))


_CLASS_SIGNALS = f"SELECT instrument, ts_ms, ts_ms + 5 * {HOUR}::BIGINT AS exit_ms, CASE WHEN called = 2 THEN 1 ELSE -1 END AS side, y FROM sc WHERE called <> 1"


@query("b02_class_trades", _recursive(with_bars("ht", "SELECT instrument, ts_ms, side, side * y - 0.0002::DOUBLE AS net FROM walk", *feature_ctes(HOUR), _SCORES, _walk_sql(_CLASS_SIGNALS, ["instrument"]))), "net")
def _(spark, d):
    side = F.when(F.col("called") == 2, 1).otherwise(-1)
    signals = _scores(spark, d).where("called <> 1").select("instrument", "ts_ms", (F.col("ts_ms") + 5 * HOUR).alias("exit_ms"), side.alias("side"), "y")
    trades = simulate.non_overlapping(signals, ["instrument"])
    return trades.select("instrument", "ts_ms", "side", (F.col("side") * F.col("y") - 0.0002).alias("net"))


_DYNAMIC_SIGNALS = 'SELECT t.instrument, t.key, t.multiplier, t.ts_ms, t.exit_ms, t.label, t.width, t."close" AS entry, t.exit_close, CASE WHEN t."close" < t."open" THEN 1 ELSE -1 END AS side FROM t WHERE label IN (0, 1, 2)'


@query("b04_dynamic_barrier_trades", _recursive(with_bars("d1", f"SELECT multiplier, ts_ms, exit_ms, label, side, {_BARRIER_GROSS} AS gross FROM walk", *dynamic_ctes(DAY), _walk_sql(_DYNAMIC_SIGNALS, ["instrument", "key"], ">"))), "multiplier gross")
def _(spark, d):
    rows = barriers.dynamic_barrier(sub.day_bars(spark, d), DAY, (0.1, 0.25)).where("label in (0, 1, 2)")
    side = F.when(F.col("close") < F.col("open"), 1).otherwise(-1)
    signals = rows.select("instrument", "multiplier", "ts_ms", "exit_ms", "label", "width", F.col("close").alias("entry"), "exit_close", side.alias("side"))
    trades = simulate.non_overlapping(signals, ["instrument", "multiplier"], strict=True)
    gross = simulate.barrier_gross(F.col("side"), F.col("label"), F.col("width"), F.col("entry"), F.col("exit_close"))
    return trades.select("multiplier", "ts_ms", "exit_ms", "label", "side", gross.alias("gross"))


@query("g08_nearest_threshold", f"SELECT instrument, cost_bps, threshold, trades FROM ({_GRID_SQL}) QUALIFY row_number() OVER (PARTITION BY instrument, cost_bps ORDER BY abs(threshold - 0.4::DOUBLE), threshold) = 1", "cost_bps threshold")
def _(spark, d):
    return splits.nearest(_grid(spark, d), ["instrument", "cost_bps"], "threshold", 0.4).select("instrument", "cost_bps", "threshold", "trades")


_HALF = "CAST(day(make_timestamp(ts_ms * 1000)) > 15 AS INT) AS half"
_HALVES_SQL = _recursive(with_bars("ht", _equity_sql(_SMALL.replace("SELECT instrument,", f"SELECT {_HALF}, instrument,"), ["instrument", "threshold", "half", "cost_bps"]), *feature_ctes(HOUR), _SCORES, _walk_sql(_SIGNALS, ["instrument", "threshold"])))


@query("g07_nested_halves", f"""SELECT o.* FROM ({_HALVES_SQL}) o JOIN (SELECT instrument, threshold FROM ({_HALVES_SQL}) WHERE half = 0 AND cost_bps = 2 AND trades >= 5
 QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY compound_return DESC, profit_factor DESC, trades DESC) = 1) USING (instrument, threshold) WHERE half = 1""", "threshold cost_bps " + _STATS)
def _(spark, d):
    """Thresholds that are best on the first half of the month, with their results on the second half at every cost."""
    trades = _trades(spark, d).withColumn("gross", F.col("gross") * 0.01).withColumn("half", (F.dayofmonth(C.at()) > 15).cast("int"))
    grid = simulate.equity(simulate.with_costs(trades, _COSTS), ["instrument", "threshold", "half", "cost_bps"])
    inner, outer = grid.where("half = 0 and cost_bps = 2").drop("half", "cost_bps"), grid.where("half = 1")
    return splits.nested(inner, outer, ["instrument"], ["threshold"], [F.desc("compound_return"), F.desc("profit_factor"), F.desc("trades")], F.col("trades") >= 5)


@query("a10_feature_stability", f"""SELECT feature, avg(advantage) AS mean, stddev_samp(advantage) AS std, min(advantage) AS min, max(advantage) AS max FROM ({_feature_auc_sql().replace("SELECT feature, (sum(", "SELECT instrument, feature, (sum(").replace("PARTITION BY feature", "PARTITION BY instrument, feature").replace("GROUP BY feature, n1, n0", "GROUP BY instrument, feature, n1, n0").replace("' AS feature", "' AS feature, instrument")}) GROUP BY 1 ORDER BY mean DESC, std, feature LIMIT 10""", "mean std min max")
def _(spark, d):
    aucs = metrics.feature_auc(_labelled(spark, d), _PICKED, ["instrument"])
    out = aucs.groupBy("feature").agg(F.avg("advantage").alias("mean"), F.stddev_samp("advantage").alias("std"), F.min("advantage").alias("min"), F.max("advantage").alias("max"))
    return out.orderBy(F.desc("mean"), "std", "feature").limit(10)


# reports over years, and audits of feature tables
_AUDITED = list(FEATURES)
def _with_targets(bars, step):
    """Every bar with its features and target, complete or not."""
    rows = features.with_features(segments.local_segments(segments.in_buckets(bars, step, 480, 60), step)).withColumns(features.future_returns(features.Rolling(), step, (5,)))
    return rows.where("own")


_CELLS = [f'"{c}"' for c in _AUDITED]


@query("p21_feature_audit", with_bars("ht", f"""SELECT instrument, count(*) AS n_rows, count(*) FILTER ({" OR ".join(f"{c} IS NULL" for c in _CELLS)}) AS n_incomplete, {" + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _CELLS)} AS n_null,
 {" + ".join(f"count(*) FILTER (isnan({c}))" for c in _CELLS)} AS n_nan, {" + ".join(f"count(*) FILTER (isinf({c}))" for c in _CELLS)} AS n_infinite, count(*) FILTER (gap < 0) AS n_backward, count(*) FILTER (gap = 0) AS n_duplicates, count(*) FILTER (gap > {HOUR}) AS n_gaps,
 {" + ".join(f"count(*) FILTER (isnan({c}) OR isinf({c}))" for c in _CELLS)} + count(*) FILTER (gap <= 0) = 0 AS passed FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY instrument ORDER BY ts_ms) AS gap FROM f) GROUP BY 1""", *feature_ctes(HOUR)))
def _(spark, d):
    return quality.feature_audit(_with_targets(sub.hour_bars_by_type(spark, d), HOUR), _AUDITED, ["instrument"], HOUR)


@query("a14_class_shares", _score_sql("SELECT instrument, called, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY instrument) AS pct FROM sc GROUP BY 1, 2"), "pct")
def _(spark, d):
    return metrics.class_shares(_scores(spark, d), "called", ["instrument"])


@query("g08_enough_trades", f"SELECT g.instrument, g.cost_bps, g.threshold, g.trades FROM ({_GRID_SQL}) g JOIN (SELECT instrument, cost_bps, trades AS most FROM ({_GRID_SQL}) WHERE threshold = 0.2::DOUBLE) a USING (instrument, cost_bps) WHERE g.trades >= 0.3::DOUBLE * most", "cost_bps threshold")
def _(spark, d):
    grid = _grid(spark, d)
    return splits.enough_trades(grid, grid.where("threshold = 0.2D"), ["instrument", "cost_bps"], 0.3).select("instrument", "cost_bps", "threshold", "trades")


@query("a07_flat_runs_and_volatility", with_bars("hq", f"""SELECT {_YEAR} AS year, count(*) AS n_rows, count(*) FILTER (run_length >= 3) AS n_flat, count(*) FILTER (sd = 0) AS n_still, count(*) FILTER (run_length >= 3 AND sd = 0) AS n_both FROM (SELECT *, count(*) OVER (PARTITION BY instrument, run) AS run_length FROM
 (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY ts_ms) AS run, CASE WHEN count(*) OVER w3 = 3 THEN stddev_samp("close") OVER w3 END AS sd FROM (SELECT *, CASE WHEN "close" = lag("close") OVER w AND segment = lag(segment) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY instrument ORDER BY ts_ms))
 WINDOW w3 AS (PARTITION BY instrument, segment ORDER BY ts_ms ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) GROUP BY 1""", seg(HOUR)))
def _(spark, d):
    runs = segments.flat_runs(sub.coarse_hour_bars(spark, d), HOUR)
    still = features.windows(sub.coarse_hour_bars(spark, d), HOUR, lambda r: {"deviation": r.std("close", 3)}, 3).select("instrument", "ts_ms", "deviation")
    return diagnostics.flat_and_still(runs.join(still, ["instrument", "ts_ms"], "left"), "deviation", 3)


@query("r06_stream_sessions", """SELECT event_type, min(t) // 1000 AS start_ms, (max(t) + 7200000000) // 1000 AS end_ms, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY t, event_id) AS k FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh
 FROM (SELECT event_type, epoch_us(ts) AS t, event_id FROM events))) GROUP BY event_type, k""")
def _(spark, d):
    """Sessions of a stream that the watermark has closed, and at the end of the stream those that it still held back."""
    place, events = src.shared_folder(spark, "sessions"), src.table(spark, d, "events")
    stream = streaming.read_events(spark, f"{d}/events[.]parquet", events.schema)
    streaming.run_available(streaming.stream_sessions(stream, "2 hours", "event_type"), f"{place}/out", f"{place}/checkpoint")
    return streaming.flushed(spark.read.parquet(f"{place}/out"), events, "2 hours", "event_type")


@query("a04_mean_barrier", with_bars("d1", "SELECT multiplier, avg(width) * 10000 AS mean_barrier_bps FROM t WHERE label IN (0, 1, 2) GROUP BY 1", *dynamic_ctes(DAY)), "multiplier mean_barrier_bps")
def _(spark, d):
    return barriers.dynamic_barrier(sub.day_bars(spark, d), DAY, (0.1, 0.25)).where("label in (0, 1, 2)").groupBy("multiplier").agg((F.avg("width") * 10000).alias("mean_barrier_bps"))


def _yearly_auc_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT {_YEAR} AS year, '{c}' AS feature, {c} AS p, CAST(future_return_5m > 0 AS INT) AS up FROM f WHERE future_return_5m IS NOT NULL AND {c} IS NOT NULL" for c in _AUDITED)
    return with_bars("d1", """SELECT year, feature, auc, abs(auc - 0.5) AS advantage, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign FROM (SELECT year, feature, (sum(CASE WHEN up = 1 THEN r END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS auc, n1, n0 FROM
 (SELECT *, count(*) FILTER (up = 1) OVER (PARTITION BY year, feature) AS n1, count(*) FILTER (up = 0) OVER (PARTITION BY year, feature) AS n0, rank() OVER (PARTITION BY year, feature ORDER BY p) + (count(*) OVER (PARTITION BY year, feature, p) - 1) / 2.0::DOUBLE AS r FROM lg) GROUP BY year, feature, n1, n0)
 WHERE n1 + n0 >= 50 AND n1 > 0 AND n0 > 0""", *feature_ctes(DAY), f"lg AS ({cells})")


@query("m07_yearly_feature_auc", _yearly_auc_sql(), "auc advantage")
def _(spark, d):
    rows = diagnostics.with_year(_with_targets(sub.day_bars(spark, d), DAY)).dropna(subset=["future_return_5m"]).withColumn("y", (F.col("future_return_5m") > 0).cast("int"))
    return metrics.feature_auc(rows, _AUDITED, ["year"], 50).select("year", "feature", "auc", "advantage", "sign")


# samples of exact size, second series, names
_DRAW = "md5('42:' || instrument || ':' || ts_ms)"


@query("t11_exact_sample", with_bars("m1", f"SELECT instrument, ts_ms FROM b ORDER BY {_DRAW}, ts_ms LIMIT 1000"))
def _(spark, d):
    return splits.exact_sample(sub.minute_bars(spark, d), 1000).select("instrument", "ts_ms")


@query("t11_proportional_sample", with_bars("ht", f"""SELECT instrument, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY {_DRAW}) AS place FROM b) JOIN
 (SELECT instrument, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, instrument) <= total - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM
  (SELECT instrument, total, total * n // all_n AS whole, total * n % all_n AS rest FROM (SELECT instrument, count(*) AS n, sum(count(*)) OVER () AS all_n, least(777, sum(count(*)) OVER ()) AS total FROM b GROUP BY 1))) USING (instrument) WHERE place <= quota""", ))
def _(spark, d):
    """777 rows, each instrument in proportion to its rows."""
    rows = sub.hour_bars_by_type(spark, d)
    return splits.exact_sample(rows, splits.quotas(rows, 777, ["instrument"]), by=["instrument"]).select("instrument", "ts_ms")


@query("s14_csv_integrity", with_bars("h1", "SELECT 4::BIGINT AS n_files, count(*) AS n_rows, 0::BIGINT AS n_nul, 0::BIGINT AS n_broken, 0::BIGINT AS n_headers_wrong, 0::BIGINT AS n_missing, 0::BIGINT AS n_not_finite, 0::BIGINT AS n_backward, 0::BIGINT AS n_borders_backward, true AS passed FROM b"))
def _(spark, d):
    """Bars are written in order of time as four CSV files, which are read back as bytes and as values."""
    bars = sub.hour_bars(spark, d).select("ts_ms", "open", "high", "low", "close")
    path = src.shared_folder(spark, "csv") + "/bars"
    ordered = bars.repartitionByRange(4, "ts_ms").sortWithinPartitions("ts_ms")
    ordered.write.option("header", True).csv(path)
    return src.verify_csv(spark, path, bars.schema)


_INDEX_NAMES = list(_INDEX)
_INDEX_CELLS = " + ".join(f"count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c}))" for c in _INDEX_NAMES)


@query("p22_second_series", with_bars("o1", f"""SELECT *, CASE WHEN n_missing + n_not_positive + n_invalid + n_backward + n_duplicates + n_features_not_finite = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM
 (SELECT a.instrument, n_rows, n_missing, n_not_positive, n_invalid, n_backward, n_duplicates, first_ms, last_ms, coalesce(n_not_one_step, 0) AS n_not_one_step, coalesce(n_feature_rows, 0) AS n_feature_rows, coalesce(n_features_not_finite, 0) AS n_features_not_finite FROM ({_AUDIT.format(by="instrument", step=DAY, source="b")}) a
  LEFT JOIN (SELECT instrument, count(*) FILTER (gap <> {DAY}) AS n_not_one_step FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY instrument ORDER BY ts_ms) AS gap FROM b) GROUP BY 1) USING (instrument)
  LEFT JOIN (SELECT instrument, count(*) AS n_feature_rows, {_INDEX_CELLS} AS n_features_not_finite FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _INDEX_NAMES)} GROUP BY 1) USING (instrument))""", *feature_ctes(DAY)))
def _(spark, d):
    bars = sub.order_day_bars(spark, d)
    return quality.series_verdict(bars, features.index_features(bars, DAY), _INDEX_NAMES, DAY)


_CLASS_P = "list_transform([value, event_id % 97, event_id % 89], lambda x: abs(x) / (abs(value) + event_id % 97 + event_id % 89 + 1))"


@query("f11_confident", f"SELECT event_id, CASE WHEN best <> 1 AND most < 0.55::DOUBLE THEN 1 ELSE best END AS called FROM (SELECT event_id, list_max(p) AS most, CAST(list_position(p, list_max(p)) - 1 AS INT) AS best FROM (SELECT event_id, {_CLASS_P} AS p FROM events))")
def _(spark, d):
    """Short, flat or long by the greatest class probability, flat where it is under 0.55."""
    weights = [F.abs("value"), (F.col("event_id") % 97).cast("double"), (F.col("event_id") % 89).cast("double")]
    total = F.abs("value") + (F.col("event_id") % 97) + (F.col("event_id") % 89) + 1
    return src.table(spark, d, "events").select("event_id", C.confident(F.array(*[w / total for w in weights]), 0.55).alias("called"))


@query("f14_names", with_bars("ht", "SELECT name, string_agg(instrument, '|' ORDER BY n DESC, instrument) AS instruments FROM (SELECT instrument, 'from_' || replace(printf('%.2f', floor(avg(\"close\") / 10) * 10), '.', 'p') AS name, count(*) AS n FROM b GROUP BY 1) GROUP BY 1"))
def _(spark, d):
    """Instruments by the ten that their mean close is in, as names: from_40p00, and a|b in order of their number of bars."""
    each = sub.hour_bars_by_type(spark, d).groupBy("instrument").agg(F.count("*").alias("n"), (F.floor(F.avg("close") / 10) * 10).alias("ten"))
    named = each.withColumn("name", F.concat(F.lit("from_"), C.number_name(F.col("ten"))))
    return named.groupBy("name").agg(C.piped(F.col("instrument"), F.struct(-F.col("n"), F.col("instrument"))).alias("instruments"))


# boosting on histograms, and nested selection with it inside
@query("m02_boosted_classes")
def _(spark, d):
    train, valid = _train_parts(spark, d)
    model = boosting.boosted(train, _FEW, "cls", 3, rounds=8)
    rows = boosting.predicted(model, valid.withColumnRenamed("cls", "y"))
    return metrics.classification(rows.select(F.col("y").cast("int").alias("y"), "p"), [0, 1, 2])


_NESTED_HORIZONS, _OUTER_YEARS, _NESTED_THRESHOLDS = (5, 15), (1997, 1999, 2001), (0.05, 0.1, 0.2)


def _nested_rows(spark, d):
    rows = features.with_features(segments.local_segments(segments.in_buckets(sub.day_bars(spark, d), DAY, 480, 60), DAY))
    rows = rows.withColumns(features.future_returns(features.Rolling(), DAY, _NESTED_HORIZONS)).where("own")
    rows = diagnostics.with_year(rows).dropna(subset=_FEW)
    return rows.select("instrument", "ts_ms", "year", *_FEW, *[(F.col(nested.target(h)) * 0.01).alias(nested.target(h)) for h in _NESTED_HORIZONS])


def _nested_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT instrument, {_YEAR} AS year, {h} AS horizon, ts_ms, ts_ms + {h} * {DAY}::BIGINT AS exit_ms, return_5m * -0.3::DOUBLE AS p, future_return_{h}m * 0.01::DOUBLE AS y FROM f WHERE future_return_{h}m IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _FEW)}" for h in _NESTED_HORIZONS)
    years = ", ".join(f"({y}, {k}, {y - 1 + k})" for y in _OUTER_YEARS for k in (0, 1))
    values = ", ".join(f"({t}::DOUBLE)" for t in _NESTED_THRESHOLDS)
    signals = f"SELECT instrument, outer_year, part, horizon, threshold, ts_ms, exit_ms, CASE WHEN p > threshold THEN 1 ELSE -1 END AS side, y FROM nr JOIN (VALUES {years}) v(outer_year, part, of_year) ON year = of_year, (VALUES {values}) t(threshold) WHERE p > threshold OR p < -threshold"
    keys = ["instrument", "outer_year", "part", "horizon", "threshold"]
    trades = "SELECT outer_year, part, horizon, threshold, cost_bps, ts_ms, side, side * y AS gross, side * y - cost_bps / 10000.0::DOUBLE AS net FROM walk, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) c(cost_bps)"
    grid = _equity_sql(trades, ["outer_year", "part", "horizon", "threshold", "cost_bps"])
    picked = "SELECT outer_year, horizon, threshold FROM grid WHERE part = 0 AND cost_bps = 2 AND trades >= 5 QUALIFY row_number() OVER (PARTITION BY outer_year ORDER BY compound_return DESC, trades DESC, horizon, threshold) = 1"
    return _recursive(with_bars("d1", f"SELECT grid.* EXCLUDE (part) FROM grid JOIN ({picked}) USING (outer_year, horizon, threshold) WHERE part = 1", *feature_ctes(DAY), f"nr AS ({cells})", _walk_sql(signals, keys), f"grid AS ({grid})"))


@query("g07_nested_years", _nested_sql(), "threshold cost_bps " + _STATS)
def _(spark, d):
    """Of each outer year its inner year's best horizon and threshold, traded at four costs; the score is a fixed rule."""
    return nested.nested_selection(_nested_rows(spark, d), nested.rule(F.col("return_5m") * -0.3), _NESTED_HORIZONS, _OUTER_YEARS, _NESTED_THRESHOLDS, _COSTS, DAY)


@query("g07_nested_models")
def _(spark, d):
    """The same with boosted regressions inside, whose rounds the inner year tells."""
    scorer = nested.boosted_scores(_FEW, DAY, 8)
    return nested.nested_selection(_nested_rows(spark, d), scorer, _NESTED_HORIZONS, _OUTER_YEARS[-1:], (0.0, 0.0005, 0.001), _COSTS, DAY)


# files of bars
def _written_years(spark, d) -> str:
    """Daily bars as CSV, a folder and a file for each year."""
    path = src.shared_folder(spark, "years") + "/csv"
    bars = diagnostics.with_year(sub.day_bars(spark, d)).select("year", F.col("ts_ms").alias("timestamp"), *PRICES.split())
    bars.repartition("year").sortWithinPartitions("year", "timestamp").write.partitionBy("year").option("header", True).csv(path)
    return path


@query("s03_many_files", with_bars("d1", f"SELECT {_YEAR} AS year, 1::BIGINT AS n_files, count(*) AS n_rows, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM b GROUP BY 1"))
def _(spark, d):
    """Many files as one table of text with each row's file name, and the numbers that its fields are."""
    rows = src.coerced(src.read_bar_files(spark, _written_years(spark, d)), ["timestamp"], "bigint")
    src.require_columns(rows, ["timestamp", *PRICES.split(), "file"])
    return rows.groupBy("year").agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


@query("s06_typed_files", with_bars("d1", 'SELECT ts_ms, "open", high, low, "close" FROM b'), PRICES)
def _(spark, d):
    """The same files, typed by the scan."""
    rows = src.read_typed_bars(spark, f"{_written_years(spark, d)}/year=*")
    return rows.select(F.col(src.first_of(rows, ["ts_ms", "timestamp"])).alias("ts_ms"), *PRICES.split())


@query("s11_created_and_added_to", with_bars("d1", 'SELECT ts_ms, "close", count(*) AS n FROM (SELECT ts_ms, "close" FROM b UNION ALL SELECT ts_ms, "close" FROM b WHERE ts_ms % 2 = 0) GROUP BY 1, 2', ), "close")
def _(spark, d):
    """A report that is written, replaced by itself, and added to."""
    path, bars = src.shared_folder(spark, "report") + "/bars", sub.day_bars(spark, d).select("ts_ms", "close")
    for rows, append in ((bars.where("ts_ms % 2 = 0"), False), (bars, False), (bars.where("ts_ms % 2 = 0"), True)):
        src.write_report(rows, path, append=append)
    return spark.read.parquet(path).groupBy("ts_ms", "close").agg(F.count("*").alias("n"))
