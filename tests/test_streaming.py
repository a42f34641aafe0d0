"""Streams of bars cut into batches anywhere against the same work on the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from quaymark.operators import barriers, features, quality, segments
from quaymark.streaming import stateful

STEP = 60_000


def series(seed, n, instruments=("a", "b"), gap=0.05):
    rng = random.Random(seed)
    rows = []
    for name in instruments:
        t, close = 0, 100.0
        for _ in range(n):
            t += STEP * (1 if rng.random() > gap else rng.randint(2, 9))
            opened, close = close, close + rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
            rows.append((name, t, opened, max(opened, close) + rng.random(), min(opened, close) - rng.random(), close))
    return rows


def batches(spark, folder, rows, cuts, run):
    """Each batch has the bars of all instruments up to the next cut."""
    for low, high in zip([0, *cuts], [*cuts, 1 << 60]):
        part = [r for r in rows if low <= (r[1] or 0) < high]
        if part:
            spark.createDataFrame(part, stateful.BAR).write.mode("append").parquet(folder)
        run()


def cuts_of(seed, rows, k):
    return sorted(random.Random(seed).sample(range(2 * STEP, max(r[1] for r in rows if r[1]), 7), k))


def rounded(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_audit_of_batches_is_the_audit_of_the_series(spark, folder):
    rows = series(1, 60)
    rows[5] = (*rows[5][:3], None, *rows[5][4:])
    rows[7] = (*rows[7][:2], -1.0, *rows[7][3:])
    rows[9] = ("a", rows[9][1] + 1, 1.0, 1.0, 1.0, 1.0)
    rows[11] = ("a", rows[11][1], 2.0, 1.0, 3.0, float("nan"))
    rows += [("c", 61 * STEP, 1.0, 2.0, 0.5, 1.0)] * 2
    audits = stateful.stream_audit(stateful.read_bars(spark, f"{folder}/in", 1000), STEP)

    def run():
        stateful.started(spark, lambda: audits.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())

    batches(spark, f"{folder}/in", rows, cuts_of(1, rows, 3), run)
    expected = quality.audit(spark.createDataFrame(rows, stateful.BAR), STEP, ["instrument"], ["ts_ms"])
    got = stateful.latest_audit(spark.read.parquet(f"{folder}/out"))
    assert rounded(got.select(*expected.columns)) == rounded(expected)


def test_a_batch_that_goes_back_counts(spark, folder):
    audits = stateful.stream_audit(stateful.read_bars(spark, f"{folder}/in", 1000), STEP)
    for t in (5 * STEP, 5 * STEP, 4 * STEP, None, 9 * STEP):
        spark.createDataFrame([("a", t, 1.0, 1.0, 1.0, 1.0)], stateful.BAR).write.mode("append").parquet(f"{folder}/in")
        stateful.started(spark, lambda: audits.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    row = stateful.latest_audit(spark.read.parquet(f"{folder}/out")).first()
    assert (row.n_rows, row.n_missing, row.n_backward, row.n_duplicates, row.n_gaps, row.longest_gap, row.first_ms, row.last_ms, row.passed) == (5, 1, 2, 1, 1, 5 * STEP, 4 * STEP, 9 * STEP, False)


def test_features_of_batches_are_those_of_the_series(spark, folder):
    rows, back = series(2, 90, gap=0.02), 12
    names = ["m", "s", "r"]

    def compute(batch):
        r = features.Rolling()
        return batch.withColumns({"m": r.mean("close", 6), "s": r.std("close", 12), "r": r.lag("close", 11)}).where("own").select("instrument", "ts_ms", *names)

    bars = stateful.carried(stateful.read_bars(spark, f"{folder}/in", 1000), STEP, back)
    write = stateful.write_once(f"{folder}/out", compute=lambda b: compute(segments.local_segments(b, STEP)))
    batches(spark, f"{folder}/in", rows, cuts_of(2, rows, 4), lambda: stateful.write_batches(bars, f"{folder}/checkpoint", write))
    whole = compute(segments.local_segments(segments.in_buckets(spark.createDataFrame(rows, stateful.BAR), STEP, back), STEP))
    got = stateful.written_rows(spark, f"{folder}/out", whole.schema).select(*whole.columns)
    assert rounded(got) == rounded(whole)


def test_labels_of_batches_and_the_flush_are_those_of_the_series(spark, folder):
    rows, configs = series(3, 80), [(0.01, 4), (0.02, 9)]

    def compute(batch):
        return barriers.touches(segments.local_segments(batch, STEP), configs).select("instrument", "ts_ms", *barriers.TOUCHED)

    bars = stateful.carried(stateful.read_bars(spark, f"{folder}/in", 1000), STEP, 0, 9)
    write = stateful.write_once(f"{folder}/out", compute=compute)
    batches(spark, f"{folder}/in", rows, cuts_of(3, rows, 4), lambda: stateful.write_batches(bars, f"{folder}/checkpoint", write))
    whole = barriers.triple_barrier(spark.createDataFrame(rows, stateful.BAR), STEP, configs).select("instrument", "ts_ms", *barriers.TOUCHED)
    emitted = stateful.written_rows(spark, f"{folder}/out", whole.schema).select(*whole.columns)
    flushed = compute(stateful.waiting_bars(spark, f"{folder}/checkpoint"))
    assert emitted.count() and flushed.count() and rounded(emitted.unionByName(flushed)) == rounded(whole)


def test_a_replayed_batch_adds_nothing(spark, folder):
    write = stateful.write_once(f"{folder}/out")
    rows = series(4, 20)
    parts = [spark.createDataFrame(p, stateful.BAR) for p in (rows[:10] + rows[20:30], rows[10:20], rows[25:40])]
    for number, part in ((0, parts[0]), (0, parts[0]), (1, parts[1]), (0, parts[0]), (1, parts[1]), (2, parts[2]), (3, parts[0]), (2, parts[2])):
        write(part, number)
    got = stateful.written_rows(spark, f"{folder}/out", stateful.BAR).select(*stateful.BAR_NAMES)
    assert rounded(got) == sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_the_setting_of_the_state_store_is_given_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)

    class Query:
        def awaitTermination(self):  # noqa: N802
            assert "RocksDB" in spark.conf.get(name)
            raise KeyError

    with pytest.raises(KeyError):
        stateful.started(spark, Query)
    assert spark.conf.get(name, None) == before
    assert spark.range(3).agg(F.sum("id")).first()[0] == 3
