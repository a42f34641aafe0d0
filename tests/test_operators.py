"""Hand-written bars with the results that the rules give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quaymark.operators import align, barriers, diagnostics, features, metrics, ml, quality, segments, simulate, splits
from quaymark.sources import tables as src

STEP = 60_000


def bars(spark, rows, instrument="x"):
    """rows: (minute, open, high, low, close) or (minute, close)."""
    full = [(instrument, r[0] * STEP, *map(float, r[1:] if len(r) == 5 else (r[1],) * 4)) for r in rows]
    return spark.createDataFrame(full, "instrument string, ts_ms long, open double, high double, low double, close double")


def by_minute(df, *columns):
    return {r.ts_ms // STEP: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_segments_and_lags_stop_at_gaps(spark):
    b = bars(spark, [(0, 1), (1, 2), (2, 4), (5, 8)])
    assert by_minute(segments.gap_segments(b, STEP), "segment") == {0: 1, 1: 1, 2: 1, 5: 2}
    lagged = features.windows(b, STEP, lambda r: {"lag": r.lag("close", 1), "mean": r.mean("close", 2)}, 2)
    assert by_minute(lagged, "lag", "mean") == {0: (None, None), 1: (1.0, 1.5), 2: (2.0, 3.0), 5: (None, None)}


def test_buckets_give_what_one_window_gives(spark):
    rng = random.Random(1)
    minutes = sorted(rng.sample(range(900), 800))
    b = bars(spark, [(m, rng.randint(1, 9)) for m in minutes])
    make = lambda r: {"m": r.mean("close", 30), "s": r.std("close", 30), "next": r.lead("close", 7)}
    one, many = (by_minute(features.windows(b, STEP, make, 30, 7, size), "m", "s", "next") for size in (100_000, 40))
    assert one == many
    for across in (False, True):
        one, many = (by_minute(segments.flat_runs(b, STEP, across, size), "segment", "run", "run_length") for size in (100_000, 16))
        assert one == many


def test_a_halo_must_fit(spark):
    with pytest.raises(ValueError):
        segments.in_buckets(bars(spark, [(0, 1)]), STEP, 50, 0, 40)


def test_flat_candles_have_zero_ratios(spark):
    row = bars(spark, [(0, 5)]).withColumns(features.candle()).first()
    assert (row.body_range_ratio, row.upper_wick_ratio, row.lower_wick_ratio) == (0.0, 0.0, 0.0)


def test_only_long_runs_are_closed(spark):
    b = bars(spark, [(m, 1) for m in range(59)] + [(59, 2)] + [(m, 3) for m in range(60, 120)])
    masked = segments.closed_mask(segments.flat_runs(b, STEP), 60)
    assert [m for m, c in by_minute(masked, "closed").items() if c] == list(range(60, 120))
    assert segments.segment_table(segments.active_segments(masked, STEP), "active_segment", STEP).first().length == 60


@pytest.mark.parametrize(
    ("ahead", "label", "hit"),
    [([(100, 126, 100, 105)], 2, 2), ([(100, 100, 70, 95)], 0, 0), ([(100, 125, 75, 100)], -1, 3), ([(100, 125, 95, 100)], 2, 2), ([(100, 101, 99, 100)], 1, 1), ([], -2, -1)],
)
def test_first_touch(spark, ahead, label, hit):
    b = bars(spark, [(0, 100, 100, 100, 100), *[(i + 1, *a) for i, a in enumerate(ahead)]])
    row = barriers.triple_barrier(b, STEP, [(0.25, 1)]).orderBy("ts_ms").first()
    assert (row.label, row.hit) == (label, hit)
    assert (row.exit_ms, row.elapsed) == ((STEP, 1.0) if ahead else (None, None))


def test_zero_volatility_is_invalid(spark):
    out = barriers.dynamic_barrier(bars(spark, [(m, 7) for m in range(70)]), STEP, [1.0], 2, 10)
    assert {r.label for r in out.collect()} == {-2}
    reasons = barriers.invalid_reasons(bars(spark, [(m, 7) for m in range(40)]), STEP, 2, 10)
    assert {r.reason for r in reasons.where(f"ts_ms between {11 * STEP} and {37 * STEP}").collect()} == {"zero_volatility"}


def test_deadzone_edges_are_flat(spark):
    from quaymark.functions.columns import deadzone

    df = spark.createDataFrame([(0.0002,), (-0.0002,), (0.00021,), (-0.00021,), (None,)], "r double")
    assert [r[0] for r in df.select(deadzone(F.col("r"), 0.0002)).collect()] == [1, 1, 2, 0, None]


@pytest.mark.parametrize(("strict", "taken"), [(False, [0, 3, 6, 9]), (True, [0, 4, 8])])
def test_trades_do_not_overlap(spark, strict, taken):
    rows = [("a", m * STEP, (m + 3) * STEP) for m in range(10)] + [("b", 5 * STEP, 6 * STEP)]
    df = spark.createDataFrame(rows, "g string, ts_ms long, exit_ms long")
    out = simulate.non_overlapping(df, ["g"], strict=strict).collect()
    assert sorted(r.ts_ms // STEP for r in out if r.g == "a") == taken
    assert [r.ts_ms // STEP for r in out if r.g == "b"] == [5]


def test_equity(spark):
    df = spark.createDataFrame([("a", i, 1, x, x) for i, x in enumerate([0.5, -0.5, 0.2, -1.5])] + [("w", i, -1, 0.1, 0.1) for i in range(2)], "g string, ts_ms long, side int, gross double, net double")
    rows = {r.g: r for r in simulate.equity(df, ["g"]).collect()}
    assert rows["a"].compound_return == pytest.approx(1.5 * 0.5 * 1.2 * -0.5 - 1)
    assert rows["a"].max_drawdown == pytest.approx(1.5 * 0.5 * 1.2 * -0.5 / 1.5 - 1)
    assert rows["w"].profit_factor is None and rows["w"].compound_return == pytest.approx(0.21)
    clamped = {r.g: r for r in simulate.equity(df, ["g"], clamp=True, from_one=True).collect()}
    assert clamped["a"].compound_return == -1.0 and clamped["a"].max_drawdown == -1.0


def test_rsi_without_moves_is_null(spark):
    rows = features.feature_set(bars(spark, [(m, 7) for m in range(560)]), STEP)
    assert {r.rsi_14 for r in features.more_features(rows, STEP).collect()} == {None}


def test_duplicates(spark):
    b = bars(spark, [(0, 1), (0, 2), (1, 3)])
    assert quality.first_of_time(b, ["close"]).count() == 2
    with pytest.raises(Exception, match="duplicate time"):
        quality.guard_strict(b).collect()
    audit = quality.audit(b, STEP, ["instrument"], ["ts_ms", "close"]).first()
    assert (audit.n_duplicates, audit.n_backward, audit.passed) == (1, 1, False)


def test_purging_is_strict(spark):
    df = spark.createDataFrame([("train", 0, 10), ("train", 1, 9), ("valid", 12, 15)], "part string, ts_ms long, end long").withColumn("valid_start", F.lit(10))
    assert sorted(r.ts_ms for r in splits.purged(df, F.col("end")).collect()) == [1, 12]


def test_joins_guard_their_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        align.one_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="key without values"):
        align.looked_up(a, b.limit(1), ["k"]).collect()
    assert align.looked_up(a, b.limit(1), ["k"], strict=False).count() == 1


def test_auc_and_precision_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(df).first().auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.average_precision(df).first().average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_csv_and_reports(spark, tmp_path):
    path = str(tmp_path / "bars.csv")
    (tmp_path / "bars.csv").write_text("timestamp,open,high,low,close\n1704067200000,1,2,0.5,x\n1704067260000,1,2,0.5,1.5\n")
    df = src.coerced(src.require_columns(src.read_bar_files(spark, path), ["timestamp", "close"]), ["open", "high", "low", "close"])
    df = src.detect_epoch_ms(src.coerced(df, ["timestamp"], "bigint"), "timestamp")
    assert [(r.timestamp, r.close, r.file) for r in df.orderBy("timestamp").collect()] == [(1704067200000, None, "bars.csv"), (1704067260000, 1.5, "bars.csv")]
    with pytest.raises(ValueError):
        src.require_columns(df, ["volume"])
    assert src.first_of(df, ["label", "close"]) == "close"
    out = bars(spark, [(0, 1), (1, 2)])
    src.write_report(out, str(tmp_path / "out"))
    checked = src.verify_output(spark, str(tmp_path / "out"), out.schema).first()
    assert (checked.n_rows, checked.n_duplicates, checked.n_not_finite) == (2, 0, 0)


def test_models_save_and_load(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(x, float(x > 0)) for x in (rng.gauss(0, 1) for _ in range(200))], "x double, y double")
    model = ml.logistic(df, ["x"], "y")
    ml.save(model, str(tmp_path / "model"))
    first, again = (ml.predicted(m, df).select("p").collect() for m in (model, ml.load(str(tmp_path / "model"))))
    assert first == again and sum(r.p == y for r, (_, y) in zip(first, df.collect())) > 190


def test_label_percentages_add_up(spark):
    df = spark.createDataFrame([(k,) for k in (0, 0, 1, 2, -1, -2, -3)], "label int")
    row = diagnostics.label_counts(df, []).first()
    assert row.n_valid == 4 and row.short_pct + row.timeout_pct + row.long_pct == pytest.approx(100)


def _series(spark, n=400, seed=5):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(3 * n), n))
    return spark.createDataFrame([("ab"[i % 2], 60_000 * t, float(rng.randint(1, 9))) for i, t in enumerate(times)], "instrument string, ts_ms long, close double").repartition(5), times


def test_buckets_give_the_same_as_one_window(spark):
    """Gaps, strides and windows over rows, in buckets of a few steps and in one window."""
    rows, _ = _series(spark)
    w = Window.partitionBy("instrument").orderBy("ts_ms")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows.withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(w))
    assert key(quality.with_gaps(rows, ["instrument"], ["ts_ms"], bucket_bars=4)) == key(want)
    nothing = rows.unionByName(rows.limit(1).withColumn("ts_ms", F.lit(None).cast("long")))
    assert quality.with_gaps(nothing, ["instrument"], ["ts_ms"], bucket_bars=4).where("gap is null").count() == 3
    want = rows.withColumn("n", F.row_number().over(w) - 1).where("n % 7 = 0").drop("n")
    assert key(splits.strided(rows, 7, span_ms=240_000)) == key(want)
    r = features.Rolling(segmented=False)
    cut = segments.in_row_buckets(rows, 6, 240_000, 8).withColumns({"before": r.lag("close", 5), "mean": r.mean("close", 6)}).where("own").drop("own", "bucket")
    frame = w.rowsBetween(-5, 0)
    want = rows.withColumns({"before": F.lag("close", 5).over(w), "mean": F.when(F.count("close").over(frame) == 6, F.avg("close").over(frame))})
    assert key(cut.select(*want.columns)) == key(want)


def test_scores_in_ranges_and_spans_in_cells(spark):
    rng = random.Random(7)
    scores = [(rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 0.5]), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(scores, "p double, y int")
    pos, neg = [p for p, y in scores if y], [p for p, y in scores if not y]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(df).first().auc == pytest.approx(won / len(pos) / len(neg))
    steps = 0.0
    for p in sorted({p for p, _ in scores}, reverse=True):
        hits = sum(y for q, y in scores if q == p)
        steps += hits * sum(y for q, y in scores if q >= p) / sum(q >= p for q, _ in scores)
    assert metrics.average_precision(df).first().average_precision == pytest.approx(steps / len(pos))
    spans = [(f"s{i}", s := rng.randint(0, 500), s + rng.choice([0, 3, 40])) for i in range(60)]
    got = {(r.a, r.b): r.overlap_ms for r in quality.overlaps(spark.createDataFrame(spans, "name string, start_ms long, end_ms long")).collect()}
    assert got == {(a, b): min(f, h) - max(e, g) for a, e, f in spans for b, g, h in spans if a < b and e <= h and g <= f}


def test_as_of_in_dense_buckets(spark):
    rng = random.Random(9)
    left, right = sorted(rng.sample(range(3000), 200)), sorted(rng.sample(range(3000), 100))
    df = lambda x: spark.createDataFrame([("a", t, float(t)) for t in x], "instrument string, ts_ms long, close double")
    got = {r.ts_ms: r.r_ms for r in align.as_of(df(left), df(right), ["close"], 50).collect()}
    assert got == {t: max((x for x in right if t - 50 < x <= t), default=None) for t in left}


def test_feature_audit_fails_on_bad_values(spark):
    rows = [("a", 0, 1.0, None), ("a", 60_000, float("nan"), 2.0), ("a", 60_000, 1.0, float("inf")), ("b", 0, 1.0, 1.0), ("b", 180_000, None, 1.0)]
    df = spark.createDataFrame(rows, "instrument string, ts_ms long, x double, y double")
    got = {r.instrument: r.asDict() for r in quality.feature_audit(df, ["x", "y"], ["instrument"], 60_000).collect()}
    assert (got["a"]["n_nan"], got["a"]["n_infinite"], got["a"]["n_null"], got["a"]["n_duplicates"], got["a"]["passed"]) == (1, 1, 1, 1, False)
    assert (got["b"]["n_incomplete"], got["b"]["n_gaps"], got["b"]["passed"]) == (1, 1, True)


def test_models_learn_and_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(3)
    data = [(x := rng.random(), z := rng.random(), 2 * x - z, float(x > z), float((x > 0.3) + (x > 0.7)), i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(data, "a double, b double, y double, up double, cls double, held boolean").orderBy("a", "b")
    once, again = df.coalesce(1), df.repartition(3, "held").sortWithinPartitions("a", "b")
    for fit, label in ((lambda r: ml.boosted_regression(r, ["a", "b"], "y", 10, "held"), "y"), (lambda r: ml.boosted_binary(r, ["a", "b"], "up", 5), "up"), (lambda r: ml.logistic(r, ["a", "b"], "up"), "up")):
        errors = [ml.predicted(fit(rows), df).select(F.avg(F.abs(F.col("p") - F.col(label)))).first()[0] for rows in (once, again)]
        spread = df.select(F.avg(F.abs(F.col(label) - 0.5))).first()[0]
        assert errors[0] < 0.6 * spread and errors[0] == pytest.approx(errors[1], abs=0.05)
    forest = ml.predicted(ml.forest(once, ["a", "b"], "cls"), df)
    assert forest.where("p = cls").count() > 0.9 * df.count()


def test_typed_bars_and_appended_reports(spark, tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,open,high,low,close\n1,1,2,0.5,1\nbad,1,x,0.5,1\n")
    rows = src.read_typed_bars(spark, str(tmp_path / "x.csv")).collect()
    assert [(r.timestamp, r.high) for r in rows] == [(1, 2.0), (None, None)]
    df = spark.createDataFrame([(1,)], "n int")
    src.write_report(df, f"{tmp_path}/r")
    src.write_report(df, f"{tmp_path}/r", append=True)
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2


def test_fallback_where_nothing_is_eligible(spark):
    grid = spark.createDataFrame([("a", 0.2, 9, 0.1), ("a", 0.5, 3, 0.3), ("b", 0.2, 1, 0.9), ("b", 0.6, 1, 0.1)], "instrument string, threshold double, trades int, result double")
    got = splits.selected_or_fallback(grid, ["instrument"], [F.desc("result")], F.col("trades") >= 3, "threshold", 0.5)
    assert {(r.instrument, r.threshold, r.chosen) for r in got.collect()} == {("a", 0.5, "best"), ("b", 0.6, "fallback")}
