"""Bars and sessions of event streams by Structured Streaming: state carries over batches, watermarks hold back and close, checkpoints make the output exactly-once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import at, epoch_ms


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_bars(events: DataFrame, step: str, late: str = "10 minutes", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a stream, by times in whole milliseconds as those of a table: a bar is emitted once, when the watermark has passed its end."""
    key = F.struct(F.col(ts), F.col(tie))
    timed = events.withColumn("_t", at(epoch_ms(ts))).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", step).alias("w")).agg(F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"))
    return out.select(F.unix_millis("w.start").alias("ts_ms"), "open", "high", "low", "close")


def stream_sliding(events: DataFrame, length: str, slide: str, by: str, late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Number, sum, least and greatest of each key over windows that overlap: every event counts in length / slide of them. A window is emitted once, when the watermark has passed its end."""
    timed = events.withColumn("_t", at(epoch_ms(ts))).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", length, slide).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(24,6)")).cast("double").alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(by, F.unix_millis("w.start").alias("start_ms"), "n", "total", "least", "most")


def stream_sessions(events: DataFrame, gap: str, by: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Runs of events of the same key without a gap: key, start, end and number. A session is emitted once, when the watermark has passed its end."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return _sessions(timed, gap, by)


def _sessions(timed: DataFrame, gap: str, by: str) -> DataFrame:
    counted = timed.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def flushed(emitted: DataFrame, events: DataFrame, gap: str, by: str, ts: str = "ts") -> DataFrame:
    """At the end of a stream: the sessions that it emitted, and those that the watermark still holds back, from each key's events after its last emitted one."""
    last = emitted.groupBy(by).agg(F.max("end_ms").alias("_last"))
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).join(last, by, "left")
    return emitted.unionByName(_sessions(timed.where(F.col("_last").isNull() | (F.unix_millis("_t") >= F.col("_last"))), gap, by))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what there is to path and ends; a further call goes on where this one ended and emits nothing twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
