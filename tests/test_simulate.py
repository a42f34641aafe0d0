"""Trades and equity in chunks against a walk in order of time."""

import math
import random

import pytest

from quaymark.operators import simulate

STEP = 60_000
SCHEMA = "g string, k int, ts_ms long, exit_ms long, x double"


def walk(rows, strict):
    out, free, ended = [], {}, set()
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[1], r[2], r[3] if r[3] is not None else -math.inf)):
        key = r[:2]
        if key in ended or (key in free and (r[2] <= free[key] if strict else r[2] < free[key])):
            continue
        out.append((*key, r[2]))
        free[key] = r[3]
        if r[3] is None:
            ended.add(key)
    return sorted(out, key=str)


def signals(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for g, k in (("a", 1), ("a", 2), (None, 1), ("b", 1)):
        t = 0
        for _ in range(n if g == "a" else n // 9):
            t += STEP * rng.choice([1, 1, 1, 2, 40])
            rows.append((g, k, t, t + STEP * rng.randint(1, longest), rng.random()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("strict", "chunk", "longest"), [(False, 7, 5), (True, 7, 60), (False, 64, 30), (True, 64, 9), (False, 1024, 9)])
def test_trades_are_those_of_the_walk(spark, strict, chunk, longest):
    rows = signals(chunk + longest, 300, longest)
    df = spark.createDataFrame(rows, SCHEMA)
    out = simulate.non_overlapping(df, ["g", "k"], strict=strict, chunk=chunk, span_ms=50 * STEP)
    assert out.columns == df.columns
    assert sorted(((r.g, r.k, r.ts_ms) for r in out.collect()), key=str) == walk(rows, strict)


def test_odd_exits(spark):
    """Exits at or before the entry, none at all, signals without a time, and none."""
    rows = [("a", 1, i * STEP, i * STEP if i % 3 else (i - 2) * STEP, 0.0) for i in range(20)] + [("a", 1, None, 5, 0.0)]
    rows += [("b", 1, i * STEP, None if i == 6 else (i + 2) * STEP, 0.0) for i in range(20)] + [("c", 1, 3, 4, 1.0)]
    for chunk in (3, 100):
        out = simulate.non_overlapping(spark.createDataFrame(rows, SCHEMA), ["g", "k"], chunk=chunk)
        got = sorted((r.g, r.ts_ms) for r in out.collect())
        assert got == [("a", i * STEP) for i in range(20)] + [("b", i * STEP) for i in (0, 2, 4, 6)] + [("c", 3)]
    assert simulate.non_overlapping(spark.createDataFrame([], SCHEMA), ["g", "k"]).collect() == []
    alone = simulate.non_overlapping(spark.createDataFrame([("a", 1, 0, 5, 0.0), ("b", 1, 3, 9, 0.0), ("c", 1, 5, 6, 0.0)], SCHEMA), [])
    assert sorted(r.ts_ms for r in alone.collect()) == [0, 5]


@pytest.mark.parametrize("options", [{}, {"clamp": True, "from_one": True}])
def test_equity_of_spans_is_that_of_one_fold(spark, options):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b", None):
        for i in range(200):
            net = rng.choice([0.01, -0.02, 0.03, -0.01, 0.0]) if g != "b" or i != 150 else -1.5
            rows.append((g, i * STEP, rng.choice([1, -1]), net + 0.001, net))
    df = spark.createDataFrame(rows, "g string, ts_ms long, side int, gross double, net double")
    whole = {r.g: r for r in simulate.equity(df, ["g"], span_ms=10**12, **options).collect()}
    for span in (STEP, 7 * STEP):
        for r in simulate.equity(df, ["g"], span_ms=span, **options).collect():
            assert tuple(r)[1:] == pytest.approx(tuple(whole[r.g])[1:], nan_ok=True)
    for g, r in whole.items():
        e, peak, worst = 1.0, 1.0 if options else -math.inf, math.inf
        for x in rows:
            if x[0] == g:
                e *= max(0.0, 1 + x[4]) if options else 1 + x[4]
                peak = max(peak, e)
                worst = min(worst, e / peak - 1)
        assert (r.compound_return, r.max_drawdown, r.trades) == pytest.approx((e - 1, worst, 200))
