"""Streams of bars with state of their own for each instrument: running audits, features that look back over batches, labels that wait for the bars ahead, and what is left at the end.

Bars come in time order, cut into batches anywhere. State is kept by transformWithStateInPandas, which needs the RocksDB state store; started() sets it for the
stream that it starts. State is small: counters, or the last bars of an instrument. The work on bars themselves is done by the same column expressions as in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quaymark.functions.columns import OHLC, aligned, all_finite, any_null, flat_candle, positive_prices, valid_ohlc

BAR = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("ts_ms", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in OHLC]])
BAR_NAMES = BAR.names
_FLAGS = ("n_missing", "n_not_positive", "n_invalid", "n_flat", "n_unaligned", "n_not_finite")
_COUNTERS = ("n_rows", *_FLAGS, "n_backward", "n_duplicates", "n_gaps")
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_bars(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of bars that a folder has and gets; a folder that isn't there yet is made."""
    _files(spark, path).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return spark.readStream.schema(BAR).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def started(spark: SparkSession, start: Callable[[], object]) -> None:
    """Runs a stream over what there is to its end; a further call goes on where this one ended."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKSDB)
    try:
        start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    started(stream.sparkSession, lambda: stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_once(path: str, by: str = "instrument", ts: str = "ts_ms", compute: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A sink for write_batches() that adds nothing twice: a batch has a folder of its own, which a replay replaces, and rows of a key at or before its last time in earlier
    batches are left out. The last times are written beside each batch, one row a key."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = compute(batch)
        earlier = spark.createDataFrame([], T.StructType([T.StructField(by, rows.schema[by].dataType), T.StructField("_last", rows.schema[ts].dataType), T.StructField("batch", T.LongType())]))
        if number:
            earlier = spark.read.schema(earlier.schema).parquet(f"{path}/marks") if _exists(spark, f"{path}/marks") else earlier
        marks = earlier.where(F.col("batch") < number).groupBy(by).agg(F.max("_last").alias("_last"))
        fresh = rows.join(marks, by, "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        written = spark.read.schema(rows.schema).parquet(f"{path}/rows/batch={number}")
        written.groupBy(by).agg(F.max(ts).alias("_last")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return write


def _files(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def written_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_once() has written so far."""
    return spark.read.schema(schema).parquet(f"{path}/rows")


class RunningAudit(StatefulProcessor):
    """Counters of each instrument over all batches so far: ValueState of one row. Within a batch bars are taken in order of time; the first is held against the last time of earlier batches."""

    _TYPES = ", ".join(f"{c} long" for c in (*_COUNTERS, "first_ms", "last_ms", "longest_gap", "seq"))
    SCHEMA = f"instrument string, {_TYPES}"

    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counters", self._TYPES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = [*_COUNTERS, "first_ms", "last_ms", "longest_gap", "seq"]
        state = dict(zip(names, self.held.get() if self.held.exists() else [0] * len(_COUNTERS) + [None, None, None, 0]))
        frame = pd.concat(list(rows), ignore_index=True)
        state["n_rows"] += len(frame)
        for c in _FLAGS:
            state[c] += int(frame[c].sum())
        times = frame["ts_ms"].dropna().astype("int64").sort_values().to_numpy()
        if len(times):
            before = times[:1] if state["last_ms"] is None else [state["last_ms"]]
            gaps = times - [*before, *times[:-1]]
            gaps = gaps[1:] if state["last_ms"] is None else gaps
            state["n_backward"] += int((gaps <= 0).sum())
            state["n_duplicates"] += int((gaps == 0).sum())
            state["n_gaps"] += int((gaps > self.step_ms).sum())
            if len(gaps):
                state["longest_gap"] = max(int(gaps.max()), -(1 << 62) if state["longest_gap"] is None else state["longest_gap"])
            state["first_ms"] = int(times[0]) if state["first_ms"] is None else min(state["first_ms"], int(times[0]))
            state["last_ms"] = int(times[-1])
        state["seq"] += 1
        self.held.update(tuple(state[c] for c in names))
        yield pd.DataFrame({"instrument": [key[0]], **{c: pd.array([state[c]], "Int64") for c in names}})

    def close(self) -> None:
        pass


def stream_audit(bars: DataFrame, step_ms: int) -> DataFrame:
    """A row for each instrument and batch that has bars of it: the counters of quality.audit() over all bars up to there, and seq, the number of such batches.

    A step back counts in time order within a batch, and against the last time of the batch before; so counters of a stream in time order are those of the whole series.
    """
    flags = {"n_missing": any_null("ts_ms", *OHLC), "n_not_positive": ~positive_prices(), "n_invalid": ~valid_ohlc(), "n_flat": flat_candle(), "n_unaligned": ~aligned(step_ms), "n_not_finite": ~all_finite(*OHLC)}
    rows = bars.select("instrument", "ts_ms", *[F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in flags.items()])
    return rows.groupBy("instrument").transformWithStateInPandas(RunningAudit(step_ms), RunningAudit.SCHEMA, "Append", "None")


def latest_audit(audits: DataFrame) -> DataFrame:
    """The last row of each instrument, and whether it passes."""
    last = audits.groupBy("instrument").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
    bad = F.col("n_missing") + F.col("n_duplicates") + F.col("n_backward") + F.col("n_not_positive") + F.col("n_invalid")
    return last.withColumn("passed", bad == 0).drop("seq")


class CarriedBars(StatefulProcessor):
    """Gives each batch's bars what they look back and ahead at. ListState: the bars that still wait for bars ahead, and the `back` bars before the first of them.

    A bar is given out as own once it has `ahead` bars behind it or its segment has ended; with it, as own = false, go the bars that it looks at. Bars at or before the
    last time of earlier batches are left out, so a replayed file changes nothing; of equal times in a batch the smallest prices count.
    """

    SCHEMA = "instrument string, ts_ms long, open double, high double, low double, close double, bucket long, own boolean"
    STATE = "ts_ms long, open double, high double, low double, close double, done boolean"

    def __init__(self, step_ms: int, back: int, ahead: int):
        self.step_ms, self.back, self.ahead = step_ms, back, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.STATE)
        self.batches = handle.getValueState("batches", "n long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        number, last = self.batches.get() if self.batches.exists() else (0, None)
        new = pd.concat(list(rows), ignore_index=True)[["ts_ms", *OHLC]].dropna(subset=["ts_ms"])
        if last is not None:
            new = new[new["ts_ms"] > last]
        new = new.sort_values(["ts_ms", *OHLC]).drop_duplicates("ts_ms").assign(done=False)
        if not len(new):
            return
        names = ["ts_ms", *OHLC, "done"]
        old = pd.DataFrame(list(self.held.get()), columns=names)
        bars = pd.concat([old, new[names]], ignore_index=True) if len(old) else new[names].reset_index(drop=True)
        bars["done"] = bars["done"].astype(bool)
        n = len(bars)
        # a bar whose segment ends before the last bar gets no more bars
        ends = (bars["ts_ms"].diff(-1).abs().fillna(self.step_ms) != self.step_ms).to_numpy().nonzero()[0]
        ended = int(ends[-1]) + 1 if len(ends) else 0
        final = max(n - self.ahead, ended)
        first = int((~bars["done"]).to_numpy().argmax())
        own = (~bars["done"]) & (bars.index < final)
        bars.loc[own, "done"] = True
        waiting = final if final < n else n
        self.held.put([tuple(r) for r in bars.iloc[max(0, waiting - self.back) :][names].itertuples(index=False, name=None)])
        self.batches.update((number + 1, int(bars["ts_ms"].iloc[-1])))
        if own.any():
            out = bars.iloc[max(0, first - self.back) :]
            yield pd.DataFrame({"instrument": key[0], **{c: out[c] for c in names[:-1]}, "bucket": number, "own": own.loc[out.index]}).astype({"ts_ms": "int64", "bucket": "int64"})

    def close(self) -> None:
        pass


def carried(bars: DataFrame, step_ms: int, back: int, ahead: int = 0) -> DataFrame:
    """A stream of bars with bucket and own, as segments.in_buckets() gives for a table: windows within (instrument, bucket) see all that they look at."""
    return bars.groupBy("instrument").transformWithStateInPandas(CarriedBars(step_ms, back, ahead), CarriedBars.SCHEMA, "Append", "None")


def waiting_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """At the end of a stream of carried() bars: those that still wait for bars ahead, and what they look back at, read from the stream's last state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
    rows = state.select(F.col("key.instrument").alias("instrument"), "list_element.*")
    return rows.select(*BAR_NAMES, F.lit(-1).cast("long").alias("bucket"), (~F.col("done")).alias("own"))


def open_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """At the end of a stream of bars.stream_bars(): the bars that the watermark still holds open, read from the stream's last state."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    key = "struct<ts: timestamp, tie: bigint>"
    # the state has the columns of the four aggregates, in their order
    bar = F.col("value").cast(f"struct<open: double, k1: {key}, high: double, low: double, close: double, k2: {key}>")
    return state.select(F.unix_millis("key.window.start").alias("ts_ms"), bar.alias("b")).select("ts_ms", "b.open", "b.high", "b.low", "b.close")
