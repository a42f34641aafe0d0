"""Runs of bars: continuous segments, flat runs, active segments; and halo buckets, by which one long series is computed in many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars that a bucket owns.
BUCKET_BARS = 8192


def in_buckets(bars: DataFrame, step_ms: int, back: int, ahead: int = 0, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Adds bucket and own. Each bar is in its bucket, and once more in a neighbour that looks back (or ahead) at it over at most so many bars. Windows partitioned by
    (instrument, bucket) then see all they need, so a single series spreads over many tasks; rows with own = false are dropped afterwards.
    Within a continuous segment n bars are n steps, so a halo in time is enough."""
    if max(back, ahead) > bucket_bars:
        raise ValueError("a halo must fit into a bucket")
    size = bucket_bars * step_ms
    bucket = F.floor(F.col("ts_ms") / size)
    offset = F.col("ts_ms") - bucket * size
    places = [F.struct(bucket.alias("bucket"), F.lit(True).alias("own"))]
    none = F.lit(None).cast("struct<bucket: bigint, own: boolean>")
    if back:
        places.append(F.when(offset >= size - back * step_ms, F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))).otherwise(none))
    if ahead:
        places.append(F.when(offset < ahead * step_ms, F.struct((bucket - 1).alias("bucket"), F.lit(False).alias("own"))).otherwise(none))
    return bars.withColumn("_place", F.explode(F.array_compact(F.array(*places)))).select(*bars.columns, "_place.bucket", "_place.own")


def in_row_buckets(bars: DataFrame, back: int, span_ms: int, bucket_rows: int = BUCKET_BARS) -> DataFrame:
    """Adds bucket and own, as in_buckets(), for windows over so many rows back that cross gaps: buckets of bucket_rows rows, and the last rows of each once more
    in the next. Rows are numbered in time spans, whose counts are summed up in order."""
    if back > bucket_rows:
        raise ValueError("a halo must fit into a bucket")
    numbered = number_starts(with_bucket(bars, span_ms), F.lit(True), "_n")
    bucket, offset = F.floor((F.col("_n") - 1) / bucket_rows), (F.col("_n") - 1) % bucket_rows
    own = F.struct(bucket.alias("bucket"), F.lit(True).alias("own"))
    next_one = F.when(offset >= bucket_rows - back, F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))
    return numbered.withColumn("_place", F.explode(F.array_compact(F.array(own, next_one)))).select(*bars.columns, "_place.bucket", "_place.own")


def local_segments(bucketed: DataFrame, step_ms: int) -> DataFrame:
    """Adds seg: the running number of gaps within the bucket, enough to keep windows inside segments."""
    w = Window.partitionBy("instrument", "bucket").orderBy("ts_ms")
    gap = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) != step_ms).cast("int"), F.lit(0))
    return bucketed.withColumn("_gap", gap).withColumn("seg", F.sum("_gap").over(w)).drop("_gap")


def with_bucket(rows: DataFrame, span_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Adds bucket, the number of the time span; rows without a time are in one of their own before all others."""
    return rows.withColumn("bucket", F.coalesce(F.floor(F.col(ts) / span_ms), F.lit(-(1 << 62))))


def with_previous(rows: DataFrame, column: str, name: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds name: the column's value in the row before. Needs bucket, which the order has to follow; only each bucket's last value goes from bucket to bucket."""
    w = Window.partitionBy(*by, "bucket").orderBy(*order)
    last = rows.groupBy(*by, "bucket").agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    carried = last.select(*by, "bucket", F.lag("_last").over(Window.partitionBy(*by).orderBy("bucket")).alias("_carried"))
    return rows.join(carried, [*by, "bucket"]).withColumn(name, F.coalesce(F.lag(F.struct(column)).over(w), F.col("_carried"))[column]).drop("_carried")


def number_starts(rows: DataFrame, starts, name: str, by: Sequence[str] = ("instrument",), order: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Adds name: the running number (from 1) of rows of the instrument where starts holds. Needs bucket; only the buckets' counts are summed up in order."""
    w = Window.partitionBy(*by, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_start", starts.cast("int"))
    sums = counted.groupBy(*by, "bucket").agg(F.sum("_start").alias("_n"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_sum_before"))
    out = counted.join(sums, [*by, "bucket"]).withColumn(name, F.col("_sum_before") + F.sum("_start").over(w))
    return out.drop("_start", "_sum_before")


def gap_segments(bars: DataFrame, step_ms: int, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Adds segment, from 1: a new one begins where the step from the bar before isn't step_ms."""
    w = Window.partitionBy("instrument", "bucket").orderBy("ts_ms")
    rows = in_buckets(bars, step_ms, 1, 0, bucket_bars).withColumn("_new", F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(w) != step_ms, F.lit(True)))
    return number_starts(rows.where("own"), F.col("_new"), "segment").select(*bars.columns, "segment")


def flat_runs(bars: DataFrame, step_ms: int, across_gaps: bool = False, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """Adds segment, run (numbered over the series) and run_length: maximal runs of equal closes, within segments or across gaps."""
    segmented = gap_segments(bars, step_ms, bucket_bars)
    # the close before is carried over any gap: by bucket where the bar before is one step away, by order otherwise
    w = Window.partitionBy("instrument", "bucket").orderBy("ts_ms")
    rows = segmented.withColumn("bucket", F.floor(F.col("ts_ms") / (bucket_bars * step_ms)))
    ends = rows.groupBy("instrument", "bucket").agg(F.max_by(F.struct("close", "segment"), "ts_ms").alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy("instrument").orderBy("bucket"))).drop("_last")
    rows = rows.join(carried, ["instrument", "bucket"]).withColumn("_before", F.coalesce(F.lag(F.struct("close", "segment")).over(w), F.col("_carried")))
    same = F.col("close") == F.col("_before.close")
    if not across_gaps:
        same &= F.col("segment") == F.col("_before.segment")
    rows = number_starts(rows, ~F.coalesce(same, F.lit(False)), "run")
    lengths = rows.groupBy("instrument", "run").agg(F.count("*").alias("run_length"))
    return rows.join(lengths, ["instrument", "run"]).select(*bars.columns, "segment", "run", "run_length")


def closed_mask(runs: DataFrame, least: int) -> DataFrame:
    return runs.withColumn("closed", F.col("run_length") >= least)


def active_segments(masked: DataFrame, step_ms: int, bucket_bars: int = BUCKET_BARS) -> DataFrame:
    """The bars that aren't closed, with active_segment: segments cut wherever bars are missing or closed."""
    return gap_segments(masked.where("not closed").drop("segment"), step_ms, bucket_bars).withColumnRenamed("segment", "active_segment")


def segment_table(segmented: DataFrame, segment: str, step_ms: int) -> DataFrame:
    """One row for each segment: start, end (exclusive) and length."""
    return segmented.groupBy("instrument", segment).agg(F.min("ts_ms").alias("start_ms"), (F.max("ts_ms") + step_ms).alias("end_ms"), F.count("*").alias("length"))
