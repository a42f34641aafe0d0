"""Sums in order and percentiles by ranges against sorting everything."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import metrics, ranks

POINTS = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.977, "f": 1.0}


def rows_of(seed):
    rng = random.Random(seed)
    rows = [("x", rng.gauss(0, 1)) for _ in range(2000)] + [("x", 1e12), ("x", -1e300), ("x", None)]
    rows += [("y", float(rng.randint(0, 3))) for _ in range(500)] + [(None, 5.0)] * 30 + [("z", 7.0), ("only null", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [2, 16, 512])
def test_percentiles(spark, ranges):
    rows = rows_of(1)
    got = {r.g: tuple(r)[1:] for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", POINTS, ["g"], ranges).collect()}
    expected = {}
    for g, part in groupby(sorted(rows, key=lambda r: str(r[0])), key=lambda r: r[0]):
        if values := [v for _, v in part if v is not None]:
            expected[g] = tuple(np.quantile(values, list(POINTS.values())))
    assert got.keys() == expected.keys()
    for g in got:
        assert got[g] == pytest.approx(expected[g])


def test_percentiles_of_all_rows_and_of_whole_numbers(spark):
    df = spark.range(101).withColumn("v", (F.col("id") * 7) % 101)
    assert tuple(ranks.percentiles(df, "v", {"q": 0.1, "m": 0.505}).first()) == pytest.approx((10.0, 50.5))
    assert ranks.percentiles(df.where("id < 0"), "v", {"q": 0.5}, ["id"]).collect() == []


@pytest.mark.parametrize("downwards", [False, True])
def test_sums_with_one_outlier_are_spread(spark, downwards):
    rng = random.Random(2)
    values = sorted({rng.random() for _ in range(3000)} | {1e9})
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "p double, n long")
    largest = ranks.with_range(df, "p", [], 64).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 3 * len(values) / 64
    total, expected = 0, {}
    for i, v in sorted(enumerate(values), reverse=downwards):
        expected[v] = total
        total += i % 7
    assert {r.p: r.n_before for r in ranks.sums_before(df, "p", [], ["n"], downwards, 64).collect()} == expected


def test_auc_with_an_outlier_and_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)] + [(1, 1e15)]
    won = sum((p > q) + (p == q) / 2 for y, p in rows if y for z, q in rows if not z)
    n1 = sum(y for y, _ in rows)
    assert metrics.roc_auc(spark.createDataFrame(rows, "y int, p double")).first().auc == pytest.approx(won / n1 / (len(rows) - n1))
