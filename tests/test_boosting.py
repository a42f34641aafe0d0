"""Boosting on histograms, and nested selection with models inside."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import boosting, nested, simulate

DAY = 86_400_000


def labelled(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, z = rng.uniform(-1, 1), rng.gauss(0, 1)
        y = 0 if x < -0.3 else 2 if x > 0.4 and z > 0 else 1
        rows.append((x, z if rng.random() > 0.1 else None, float(y if rng.random() > 0.1 else rng.randint(0, 2)), 3 * x + (z > 0)))
    return spark.createDataFrame(rows, "x double, z double, cls double, v double")


def trees(model):
    return [(t.feature.tolist(), t.cut.tolist(), t.value.tolist()) for r in model.rounds for t in r]


def test_classes_beat_their_shares_and_do_not_depend_on_partitions(spark):
    rows = labelled(spark)
    model = boosting.boosted(rows.repartition(1), ["x", "z"], "cls", 3, rounds=6)
    again = boosting.boosted(rows.repartition(5), ["x", "z"], "cls", 3, rounds=6)
    assert trees(model) == trees(again) and np.array_equal(model.edges, again.edges)
    fresh = labelled(spark, 400, 2)
    losses = boosting.staged_losses(model, fresh, "cls")
    shares = [r["count"] / 400 for r in fresh.groupBy("cls").count().collect()]
    assert len(losses) == 7 and losses[-1] < losses[0] < 1.1 * -sum(s * math.log(s) for s in shares) and losses[-1] < 0.75 * losses[0]
    out = boosting.predicted(model, fresh).collect()
    assert sum(r.p == r.cls for r in out) / 400 > 0.75
    assert all(math.isclose(sum(r.probabilities), 1) and r.p == max(range(3), key=lambda k: r.probabilities[k]) for r in out)
    assert losses[-1] == pytest.approx(sum(-math.log(r.probabilities[int(r.cls)]) for r in out) / 400)


def test_regression_and_its_first_rounds(spark):
    rows = labelled(spark)
    model = boosting.boosted(rows, ["x", "z"], "v", rounds=12, rate=0.3)
    losses = boosting.staged_losses(model, rows, "v")
    mean = rows.agg(F.avg("v")).first()[0]
    assert losses[0] == pytest.approx(rows.agg(F.avg((F.col("v") - mean) ** 2)).first()[0])
    assert all(a > b for a, b in zip(losses, losses[1:])) and losses[-1] < 0.1 * losses[0]
    part = boosting.predicted(model.first(4), rows)
    assert part.agg(F.avg((F.col("v") - F.col("p")) ** 2)).first()[0] == pytest.approx(losses[4])


def test_one_step_of_one_feature(spark):
    """A cut between two groups, each at its mean but for the penalty."""
    rows = spark.createDataFrame([(0.0, 1.0)] * 30 + [(1.0, 3.0)] * 50 + [(None, 1.0)] * 20, "x double, y double")
    model = boosting.boosted(rows, ["x"], "y", rounds=1, depth=1, rate=1.0, bins=4)
    got = {r.x: r.p for r in boosting.predicted(model, rows.distinct()).collect()}
    assert got == pytest.approx({0.0: 2 - 50 / 51, None: 2 - 50 / 51, 1.0: 2 + 50 / 51})


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 0.0)] * 5 + [(None, None, None)], "x double, z double, cls double")
    model = boosting.boosted(rows, ["x", "z"], "cls", 3, rounds=2)
    assert boosting.predicted(model, rows).select("p").distinct().collect() == [(0,)]
    assert boosting.predicted(model, rows.limit(0)).collect() == []


def years(spark, n=900):
    """A feature that tells the next return of five days in the years before 2000 and its opposite later."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        ts = 880_000_000_000 // DAY * DAY + i * DAY
        x = rng.choice([-1.0, 1.0])
        rows.append(("i", ts, x, 0.01 * x + rng.gauss(0, 0.002), -0.01 * x))
    df = spark.createDataFrame(rows, "instrument string, ts_ms long, x double, future_return_1m double, future_return_2m double")
    return df.withColumn("year", F.year(F.timestamp_millis("ts_ms")))


def test_nested_rule_picks_on_the_inner_year_alone(spark):
    rows = years(spark).cache()
    out = nested.nested_selection(rows, nested.rule(F.col("x")), (1, 2), (1999, 2000), (0.5, 2.0), (0.0, 5.0), DAY)
    got = {(r.outer_year, r.cost_bps): r for r in out.collect()}
    assert {(r.horizon, r.threshold) for r in got.values()} == {(1, 0.5)} and len(got) == 4
    one = rows.where("year = 1999").withColumns({"exit_ms": F.col("ts_ms") + DAY, "side": F.col("x").cast("int")})
    trades = simulate.non_overlapping(one, ["instrument"]).withColumn("gross", F.col("side") * F.col("future_return_1m"))
    plain = simulate.equity(simulate.with_costs(trades, [5.0]), ["cost_bps"]).first()
    assert got[1999, 5.0].trades == plain.trades and got[1999, 5.0].compound_return == pytest.approx(plain.compound_return)
    none = nested.nested_selection(rows, nested.rule(F.col("x")), (1,), (1999,), (2.0,), (0.0,), DAY)
    assert none.collect() == []
    rows.unpersist()


def test_nested_models_freeze_the_inner_rounds(spark):
    rows = years(spark).cache()
    asked = []
    inside = nested.boosted_scores(["x"], DAY, 5, depth=1, least_rows=5)

    def scorer(table, horizon, year, rounds):
        scored, best = inside(table, horizon, year, rounds)
        asked.append((horizon, year, rounds, best))
        return scored, best

    out = nested.nested_selection(rows, scorer, (1, 2), (1999,), (0.001,), (1.0,), DAY).collect()
    assert len(out) == 1 and out[0].compound_return > 0.5
    inner = {h: best for h, y, rounds, best in asked if y == 1998}
    assert len(asked) == 4 and all(rounds is None for _, y, rounds, _ in asked if y == 1998)
    assert {h: rounds for h, y, rounds, _ in asked if y == 1999} == inner and all(1 <= b <= 5 for b in inner.values())
    rows.unpersist()
