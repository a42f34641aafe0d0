"""Trades that don't overlap, with costs. Which signals become trades is a recurrence over time; it is cut into chunks whose paths are joined, so one series is many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.sources.tables import stored

from .segments import BUCKET_BARS, number_starts, with_bucket

#: Signals of a chunk.
CHUNK = 1024
MINUTE = 60_000


def _first_at(times: str, n: Column, moment: Column, strict: bool, most: int) -> Column:
    """The place (from 1) of the first of n sorted times at or after (strict: after) the moment, n + 1 if there is none, by binary steps."""
    before = (lambda t: t <= moment) if strict else (lambda t: t < moment)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    step = lambda at, k: F.when((at + k <= n) & F.coalesce(before(F.element_at(times, F.least(at + k, n))), F.lit(True)), at + k).otherwise(at)
    return F.aggregate(steps, F.lit(0), step) + 1


def _chunks(numbered: DataFrame, strict: bool, most: int) -> DataFrame:
    """A row for each chunk: times and exits in order, n, next (the place of the signal that follows each, n + 1 outside, and n + 1 itself at the end), and last:
    the last signal of the chunk on the path from each, found by doubling."""
    rounds = F.sequence(F.lit(1), F.lit(most.bit_length()))
    cells = F.array_sort(F.collect_list(F.struct("_i", "ts_ms", "_exit")))
    rows = numbered.groupBy("_g", "_chunk").agg(cells.alias("cells")).select("_g", "_chunk", F.col("cells.ts_ms").alias("times"), F.col("cells._exit").alias("exits"), F.size("cells").alias("n"))
    follows = F.transform("exits", lambda x, i: F.greatest(_first_at("times", F.col("n"), x, strict, most), i + 2))
    rows = rows.withColumn("next", F.concat(follows, F.array(F.col("n") + 1)))
    stays = F.transform("next", lambda x, i: F.when(x > F.col("n"), i + 1).otherwise(x))
    return rows.withColumn("stays", stays).withColumn("last", F.aggregate(rounds, F.col("stays"), lambda at, _: F.transform(at, lambda i: F.element_at(at, i)))).drop("stays")


def _reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (_g, _chunk, _i) on the paths from the starts along edges (_g, _chunk, _i) -> (to_chunk, to_i), each of which has one way on: pointers are doubled, so
    the rounds are the logarithm of the longest path."""
    node = ["_g", "_chunk", "_i"]
    found, jump = stored(starts, "trade-starts"), stored(edges, "trade-jumps")
    while not jump.isEmpty():
        ahead = found.join(jump, node).select("_g", F.col("to_chunk").alias("_chunk"), F.col("to_i").alias("_i"))
        found = stored(found.unionByName(ahead), "trade-starts")
        second = jump.select("_g", F.col("_chunk").alias("to_chunk"), F.col("_i").alias("to_i"), F.col("to_chunk").alias("far_chunk"), F.col("to_i").alias("far_i"))
        jump = jump.join(second, ["_g", "to_chunk", "to_i"]).select(*node, F.col("far_chunk").alias("to_chunk"), F.col("far_i").alias("to_i"))
        jump = stored(jump, "trade-jumps")
    return found


def non_overlapping(signals: DataFrame, by: Sequence[str], exit_ts: str = "exit_ms", strict: bool = False, chunk: int = CHUNK, span_ms: int = BUCKET_BARS * MINUTE) -> DataFrame:
    """Of each group's signals, in order of ts_ms (ties: the earlier exit), those that begin at or after (strict: after) the exit of the last one taken.

    Every signal has one that would follow it. Signals are numbered over time spans and cut into chunks; within a chunk, paths are arrays. Between chunks only signals matter
    whose follower is in a later chunk: few, as trades are short against a chunk. Their graph is followed by doubling pointers, and the entries it gives are
    spread to the chunks' paths. A signal without a time is never taken, and none follows one without an exit.
    """
    rows = signals.where("ts_ms is not null").withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).withColumn("_exit", F.col(exit_ts).cast("long"))
    order = ("ts_ms", "_exit", "_tie")
    rows = rows.withColumn("_tie", F.xxhash64(*signals.columns))
    numbered = number_starts(with_bucket(rows, span_ms), F.lit(True), "_n", ["_g"], order)
    place = F.col("_n") - 1
    numbered = stored(numbered.select(*signals.columns, "_g", "_exit", F.floor(place / chunk).alias("_chunk"), (place % chunk + 1).cast("int").alias("_i")), "trade-signals")
    chunks = stored(_chunks(numbered, strict, chunk), "trade-chunks")

    leaves = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("next", i) > F.col("n"))
    leaving = chunks.select("_g", "_chunk", "exits", F.explode(leaves).alias("_i")).select("_g", "_chunk", "_i", F.element_at("exits", F.col("_i")).alias("free")).where("free is not null")
    later = (lambda t, free: t > free) if strict else (lambda t, free: t >= free)
    ends = chunks.select("_g", F.col("_chunk").alias("to_chunk"), F.element_at("times", -1).alias("end"))
    near = leaving.withColumn("to_chunk", F.col("_chunk") + 1).join(ends, ["_g", "to_chunk"])
    far = near.where(~later(F.col("end"), F.col("free"))).select("_g", "_chunk", "_i", "free")
    # exits beyond the next chunk: the first chunk that ends at or after them
    both = far.select("_g", F.col("free").alias("at"), F.lit(1 if strict else 0).alias("side"), "_chunk", "_i", "free", F.lit(None).cast("long").alias("to_chunk")).unionByName(
        ends.select("_g", F.col("end").alias("at"), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast("long").alias("_chunk"), F.lit(None).cast("int").alias("_i"), F.lit(None).cast("long").alias("free"), "to_chunk")
    )
    onward = Window.partitionBy("_g").orderBy("at", "side", F.col("to_chunk").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    far = both.withColumn("to_chunk", F.min("to_chunk").over(onward)).where("free is not null and to_chunk is not null").select("_g", "_chunk", "_i", "free", "to_chunk")
    hops = near.where(later(F.col("end"), F.col("free"))).select(*far.columns).unionByName(far)
    target = chunks.select("_g", F.col("_chunk").alias("to_chunk"), "times", "n", "last")
    entry = hops.join(target, ["_g", "to_chunk"]).withColumn("entry", _first_at("times", F.col("n"), F.col("free"), strict, chunk))
    entry = stored(entry.select("_g", "_chunk", "_i", "to_chunk", "entry", F.element_at("last", F.col("entry")).alias("to_i")), "trade-entries")

    starts = chunks.where("_chunk = 0").select("_g", "_chunk", F.element_at("last", 1).alias("_i"))
    reached = _reached(starts, entry.select("_g", "_chunk", "_i", "to_chunk", "to_i"))
    entered = entry.join(reached, ["_g", "_chunk", "_i"]).select("_g", F.col("to_chunk").alias("_chunk"), "entry").unionByName(chunks.where("_chunk = 0").select("_g", "_chunk", F.lit(1).alias("entry")))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(chunk.bit_length())),
        F.struct(F.col("next").alias("jump"), F.array("entry").alias("path")),
        lambda x, _: F.struct(
            F.transform(x["jump"], lambda i: F.element_at(x["jump"], i)).alias("jump"),
            F.concat(x["path"], F.filter(F.transform(x["path"], lambda i: F.element_at(x["jump"], i)), lambda i: i <= F.col("n"))).alias("path"),
        ),
    )
    taken = chunks.join(entered, ["_g", "_chunk"]).select("_g", "_chunk", F.explode(walk["path"]).alias("_i"))
    return numbered.join(taken, ["_g", "_chunk", "_i"]).select(*signals.columns)


def barrier_gross(side: Column, label: Column, width: Column, entry: Column, leave: Column) -> Column:
    """+-width where the label agrees or disagrees with the side (1 long, -1 short), and at a timeout the change of the close."""
    timeout = F.when(side > 0, F.try_divide(leave, entry) - 1).otherwise(F.try_divide(entry, leave) - 1)
    won = F.when(label == 1, timeout).when((label == 2) == (side > 0), width).otherwise(-width)
    return won


def with_costs(trades: DataFrame, costs_bps: Sequence[float]) -> DataFrame:
    """Every trade at every cost: which trades are made doesn't depend on the cost, so they are simulated once."""
    return trades.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps]))).withColumn("net", F.col("gross") - F.col("cost_bps") / F.lit(10_000.0))


def equity(trades: DataFrame, by: Sequence[str], clamp: bool = False, from_one: bool = False, span_ms: int = BUCKET_BARS * MINUTE) -> DataFrame:
    """Statistics of each group's trades (side, gross, net, ts_ms): a fold in order of time. clamp: a loss of more than all is all. from_one: the peak starts
    at 1, not at the first equity. profit_factor is NULL without losses.

    Time is cut into spans: each span's growth gives the equity before the next spans, then each span's highest equity the peak before them; so a window has the trades
    of one span, or one row a span.
    """
    growth = F.greatest(F.lit(0.0), 1 + F.col("net")) if clamp else 1 + F.col("net")
    parts = {"_log": F.coalesce(F.log(F.abs(F.nullif(growth, F.lit(0.0)))), F.lit(0.0)), "_minus": (growth < 0).cast("int"), "_zero": (growth == 0).cast("int")}
    rows = with_bucket(trades.withColumns(parts), span_ms)
    inside = Window.partitionBy(*by, "bucket").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "bucket"]

    def carried(rows: DataFrame, totals: dict[str, Column], over) -> DataFrame:
        """Adds what over() gives of the totals of all spans before, as _before_<name>."""
        spans = rows.groupBy(*keys).agg(*[v.alias(k) for k, v in totals.items()])
        spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[over(k).over(before).alias(f"_before{k}") for k in totals])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return rows.join(spans, same).drop(*[f"_k{i}" for i in range(len(keys))])

    rows = carried(rows, {c: F.sum(c) for c in parts}, F.sum)
    so_far = lambda c: F.coalesce(F.col(f"_before{c}"), F.lit(0)) + F.sum(c).over(inside)
    value = F.when(so_far("_zero") > 0, 0.0).otherwise(F.exp(so_far("_log")) * F.when(so_far("_minus") % 2 == 1, -1.0).otherwise(1.0))
    rows = carried(rows.withColumn("_e", value), {"_peak": F.max("_e")}, F.max)
    peak = F.greatest(F.max("_e").over(inside), F.col("_before_peak"), *([F.lit(1.0)] if from_one else []))
    rows = rows.withColumn("_down", F.try_divide(F.col("_e"), peak) - 1)
    gain, loss = F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0)), F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(F.col("side") > 0).alias("longs"), F.count_if(F.col("side") < 0).alias("shorts"), F.sum("gross").alias("gross_sum"), F.sum("net").alias("net_sum"),
        (F.max_by("_e", "ts_ms") - 1).alias("compound_return"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, gain / loss).alias("profit_factor"),
        F.min("_down").alias("max_drawdown"), F.avg("net").alias("avg_trade_net"),
    )


def threshold_signals(rows: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows with threshold and side (1 above it, -1 below minus it), once for each threshold that the score passes."""
    at = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return at.withColumn("side", F.when(F.col(score) > F.col("threshold"), 1).when(F.col(score) < -F.col("threshold"), -1)).where("side is not null")


def probability_signals(rows: DataFrame, p: str, pairs: Sequence[tuple[float, float]]) -> DataFrame:
    """Long from the upper probability on, short from the lower one down."""
    cells = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in pairs])
    at = rows.withColumn("_c", F.explode(cells)).select(*rows.columns, "_c.*")
    return at.withColumn("side", F.when(F.col(p) >= F.col("high"), 1).when(F.col(p) <= F.col("low"), -1)).where("side is not null")
