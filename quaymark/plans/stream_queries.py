"""Queries over streams of bars, with the DuckDB SQL of the whole series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import barriers, features, segments
from quaymark.sources import tables as src
from quaymark.streaming import bars as streaming
from quaymark.streaming import stateful

from . import substrate as sub
from .bar_queries import _AUDIT, _CONFIG_SQL, _CONFIGS, _PASSED, HOUR, MINUTE, PRICES, feature_ctes, query, touch_ctes
from .substrate import SQL, with_bars
from .substrate import segments as seg

#: Bars reach the stream in so many deliveries.
DELIVERIES = 3


def delivered(bars: DataFrame, folder: str, run: Callable[[], None], deliveries: int = DELIVERIES) -> None:
    """Writes bars into the folder in parts of equal spans of time, and calls run() after each, as a stream that is stopped and started again."""
    spark = bars.sparkSession
    bars = bars.select(*stateful.BAR_NAMES)
    span = bars.agg(F.min("ts_ms").alias("_from"), F.max("ts_ms").alias("_to"))
    part = F.least(F.floor((F.col("ts_ms") - F.col("_from")) * deliveries / F.greatest(F.col("_to") - F.col("_from"), F.lit(1))), F.lit(deliveries - 1))
    parts = bars.crossJoin(F.broadcast(span)).withColumn("part", part.cast("int")).drop("_from", "_to")
    parts.write.partitionBy("part").parquet(f"{folder}-all")
    for k in range(deliveries):
        spark.read.schema(stateful.BAR).parquet(f"{folder}-all/part={k}").write.mode("append").parquet(folder)
        run()


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return stateful.read_bars(spark, folder, 1000)


@query("r05_stream_audit", with_bars("m1", _PASSED.format(_AUDIT.format(by="instrument", step=MINUTE, source="b"))))
def _(spark, d):
    """The audit of a stream that comes in three runs: counters, last time and longest gap are carried over."""
    place = src.shared_folder(spark, "stream-audit")
    audits = stateful.stream_audit(_stream(spark, f"{place}/in"), MINUTE)
    run = lambda: stateful.started(spark, lambda: audits.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start())
    delivered(sub.minute_bars(spark, d), f"{place}/in", run)
    return stateful.latest_audit(spark.read.parquet(f"{place}/out"))


_FEATURES = [c for c in features.FEATURES if c.startswith(("return", "volatility", "distance")) or c.endswith("ratio")]


@query("r01_stream_features", with_bars("ht", f"SELECT instrument, ts_ms, {', '.join(_FEATURES)} FROM f", *feature_ctes(HOUR)), " ".join(_FEATURES), 4)
def _(spark, d):
    """Features of a stream in three runs: each batch gets the bars that it looks back at from state, so they are those of the whole series."""
    place = src.shared_folder(spark, "stream-features")
    bars = stateful.carried(_stream(spark, f"{place}/in"), HOUR, features.LOOKBACK)

    def compute(batch: DataFrame) -> DataFrame:
        return features.with_features(segments.local_segments(batch, HOUR)).where("own").select("instrument", "ts_ms", *_FEATURES)

    schema = compute(spark.createDataFrame([], stateful.CarriedBars.SCHEMA)).schema
    write = stateful.write_once(f"{place}/out", compute=compute)
    delivered(sub.hour_bars_by_type(spark, d), f"{place}/in", lambda: stateful.write_batches(bars, f"{place}/checkpoint", write))
    return stateful.written_rows(spark, f"{place}/out", schema).select("instrument", "ts_ms", *_FEATURES)


@query("r02_stream_barriers", with_bars("h1", 'SELECT instrument, ts_ms, width, horizon, label, hit, exit_ms, exit_close, (exit_ms - ts_ms) / 60000.0::DOUBLE AS elapsed FROM t', seg(HOUR), *touch_ctes(_CONFIG_SQL)), "width exit_close elapsed")
def _(spark, d):
    """Labels of a stream in three runs: a bar waits in state until the bars ahead have come, and at the end those that still wait are labelled with what there is."""
    place = src.shared_folder(spark, "stream-barriers")
    bars = stateful.carried(_stream(spark, f"{place}/in"), HOUR, 0, max(h for _, h in _CONFIGS))

    def compute(batch: DataFrame) -> DataFrame:
        return barriers.touches(segments.local_segments(batch, HOUR), _CONFIGS).select("instrument", "ts_ms", *barriers.TOUCHED)

    schema = compute(spark.createDataFrame([], stateful.CarriedBars.SCHEMA)).schema
    write = stateful.write_once(f"{place}/out", compute=compute)
    delivered(sub.hour_bars(spark, d), f"{place}/in", lambda: stateful.write_batches(bars, f"{place}/checkpoint", write))
    flushed = compute(stateful.waiting_bars(spark, f"{place}/checkpoint"))
    return stateful.written_rows(spark, f"{place}/out", schema).select(*flushed.columns).unionByName(flushed)


@query("r04_last_open_bars", f"""SELECT ts_ms, "open", high, low, "close" FROM ({SQL['h1']})""", PRICES)
def _(spark, d):
    """Bars of a stream of events that the watermark has closed, and at the end those that it still held open."""
    place, events = src.shared_folder(spark, "stream-bars"), src.table(spark, d, "events")
    bars = streaming.stream_bars(streaming.read_events(spark, f"{d}/events[.]parquet", events.schema), "1 hour")
    streaming.run_available(bars, f"{place}/out", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out").unionByName(stateful.open_bars(spark, f"{place}/checkpoint"))


@query("r03_delivered_twice", f"SELECT * FROM ({SQL['h1']})", PRICES)
def _(spark, d):
    """Every delivery comes twice, the second time as new files: what is at or before the last written time adds nothing."""
    place = src.shared_folder(spark, "stream-twice")
    bars = _stream(spark, f"{place}/in")
    write = stateful.write_once(f"{place}/out")

    def run() -> None:
        stateful.write_batches(bars, f"{place}/checkpoint", write)
        again = spark.read.schema(stateful.BAR).parquet(f"{place}/in")
        again.write.parquet(f"{place}/copy", mode="overwrite")
        spark.read.schema(stateful.BAR).parquet(f"{place}/copy").write.mode("append").parquet(f"{place}/in")
        stateful.write_batches(bars, f"{place}/checkpoint", write)

    delivered(sub.hour_bars(spark, d), f"{place}/in", run)
    return stateful.written_rows(spark, f"{place}/out", stateful.BAR).select(*stateful.BAR_NAMES)


@query("r06_sliding_windows", f"""SELECT event_type, start_ms, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS total, min(value) AS least, max(value) AS most FROM
 (SELECT event_type, value, (epoch_ms(ts) // {HOUR} - k) * {HOUR} AS start_ms FROM events, range(0, 3) AS r(k)) WHERE start_ms + 3 * {HOUR} <= (SELECT epoch_ms(max(ts)) FROM events) - 600000 GROUP BY 1, 2""", "total least most")
def _(spark, d):
    """Windows of three hours that begin every hour, of a stream of events; those that the watermark has closed."""
    place, events = src.shared_folder(spark, "sliding"), src.table(spark, d, "events")
    stream = streaming.stream_sliding(streaming.read_events(spark, f"{d}/events[.]parquet", events.schema), "3 hours", "1 hour", "event_type")
    streaming.run_available(stream, f"{place}/out", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out")
