"""Samples of exact size, written files with planted faults, overlaps with one long span, verdicts and names."""

import hashlib
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.functions import columns as C
from quaymark.operators import features, quality, splits
from quaymark.sources import tables as src

DAY = src.DAY


def draw(*keys):
    return hashlib.md5(":".join(map(str, ("42", *keys))).encode()).hexdigest()


def test_samples_have_their_exact_size_whatever_the_partitions(spark):
    rows = [("abc"[i % 3 if i < 300 else 0], i) for i in range(2000)]
    df = spark.createDataFrame(rows, "instrument string, ts_ms long")
    for k in (0, 1, 777, 2000, 5000):
        expected = set(sorted(rows, key=lambda r: draw(*r))[:k])
        for parts in (1, 7):
            got = splits.exact_sample(df.repartition(parts), k).collect()
            assert len(got) == min(k, 2000) and {tuple(r) for r in got} == expected
    other = {tuple(r) for r in splits.exact_sample(df, 777, seed=7).collect()}
    assert len(other) == 777 and other != {tuple(r) for r in splits.exact_sample(df, 777).collect()}


def test_proportional_samples(spark):
    sizes = {"a": 501, "b": 300, None: 150, "c": 48, "d": 1}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "instrument string, ts_ms long")
    for total in (10, 333, 1000, 4000):
        n = min(total, 1000)
        exact = {g: n * s for g, s in sizes.items()}
        quota = {g: e // 1000 for g, e in exact.items()}
        for g in sorted(sizes, key=lambda g: (-(exact[g] % 1000), g is not None, g or ""))[: n - sum(quota.values())]:
            quota[g] += 1
        table = splits.quotas(df, total, ["instrument"])
        assert {r.instrument: r.quota for r in table.collect()} == quota
        got = Counter(r.instrument for r in splits.exact_sample(df, table, by=["instrument"]).collect())
        assert got == Counter({g: q for g, q in quota.items() if q})


SCHEMA = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("close", T.DoubleType())])


def files(folder, *contents):
    os.makedirs(folder)
    for i, text in enumerate(contents):
        (folder / f"part-{i}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{folder}"


def test_faults_of_written_files_are_counted(spark, tmp_path):
    good = files(tmp_path / "good", "ts_ms,close\n1,1.5\n2,2.5\n", "ts_ms,close\n3,1.0\n")
    row = src.verify_csv(spark, good, SCHEMA).first()
    assert (row.n_files, row.n_rows, row.passed) == (2, 3, True)
    bad = files(
        tmp_path / "bad", "ts_ms,close\n1,1.5\n5,2.5\n4,x\n", b"ts_ms,close\n6,1.0\n7,1\xff.0\n8,2.0\n", b"ts_ms,close\n8,1.0\n9,\x001.0\n", "close,ts_ms\n11,12\n", "ts_ms,close\n13,NaN\n14,Infinity\n15,\n"
    )
    row = src.verify_csv(spark, bad, SCHEMA).first()
    assert (row.n_files, row.n_rows, row.n_broken, row.n_nul, row.n_headers_wrong, row.n_backward, row.n_borders_backward, row.passed) == (5, 12, 1, 1, 1, 1, 1, False)
    assert row.n_missing == 3 and row.n_not_finite == 2  # a number behind a NUL byte is still read


def test_large_files_are_checked_in_splits(spark, tmp_path):
    lines = [f"{i},{i / 7}" for i in range(20_000)]
    lines[7_000] = "6,1.0"
    path = files(tmp_path / "one", "ts_ms,close\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        row = src.verify_csv(spark, path, SCHEMA).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row.n_rows, row.n_backward, row.n_missing, row.n_headers_wrong) == (20_000, 1, 0, 0)


def test_overlaps_with_one_long_span(spark):
    rng = random.Random(1)
    spans = [(f"s{i:03}", s := rng.randint(0, 10**6), s + rng.choice([0, 5, 900, 4096])) for i in range(300)] + [("long", 0, 10**12), ("far", 10**12, 10**12 + 5), ("point", 500_000, 500_000)]
    expected = {(a[0], b[0], min(a[2], b[2]) - max(a[1], b[1])) for a in spans for b in spans if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    got = [tuple(r) for r in quality.overlaps(spark.createDataFrame(spans, "name string, start_ms long, end_ms long")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_verdict_of_a_second_series(spark):
    rows = [("i", i * DAY, 1.0 + i % 3, 3.5, 0.5, 1.0 + (i + 1) % 3) for i in range(400)]
    schema = "instrument string, ts_ms long, open double, high double, low double, close double"

    def verdict(rows):
        bars = spark.createDataFrame(rows, schema)
        return quality.series_verdict(bars, features.index_features(bars, DAY), ["return_1m", "volatility_15m"], DAY).first()

    assert verdict(rows).verdict == "PASS" and verdict(rows).n_not_one_step == 0
    assert verdict(rows[:50] + rows[53:]).n_not_one_step == 1 and verdict(rows[:50] + rows[53:]).verdict == "PASS"
    assert verdict([*rows, rows[7]]).verdict == "FAIL"
    assert verdict([*rows[:-1], ("i", 399 * DAY, 1.0, 0.5, 2.0, 1.0)]).verdict == "FAIL"
    short = verdict(rows[:5])
    assert (short.n_feature_rows, short.verdict) == (0, "PASS")


def test_confidence_and_names(spark):
    df = spark.createDataFrame([([0.5, 0.2, 0.3],), ([0.4, 0.2, 0.4],), ([0.1, 0.3, 0.6],), ([0.3, 0.4, 0.3],), (None,)], "p array<double>")
    assert [r[0] for r in df.select(C.confident(F.col("p"), 0.5)).collect()] == [0, 1, 2, 1, None]
    row = spark.createDataFrame([(0.5, "1p25")], "x double, name string").select(C.number_name(F.col("x")), C.name_number(F.col("name"))).first()
    assert row[0] == "0p50" and math.isclose(row[1], 1.25)
    names = spark.createDataFrame([("b", 1), ("a", 2), ("c", 0)], "n string, k int").agg(C.piped(F.col("n"), F.col("k"))).first()[0]
    assert names == "c|b|a"
    assert pytest.approx(0.05) == spark.range(1).select(C.name_number(C.number_name(F.lit(0.05)))).first()[0]
