"""Sums in order of a value, and exact percentiles, of groups of any size: values are cut into ranges at approximate quantiles, so no window or buffer has a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the values of a group are cut.
RANGES = 512


def same(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are equal; without keys, right is one row."""
    if not by:
        return left.crossJoin(right)
    other = right.select(*[F.col(c).alias(f"_r{i}") if c in by else F.col(c) for i, c in enumerate(right.columns)])
    names = {c: f"_r{i}" for i, c in enumerate(right.columns) if c in by}
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in by])
    return left.join(other, on, how).drop(*names.values())


def with_range(values: DataFrame, column: str, by: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Adds _range, a number that grows with the value: cuts are approximate quantiles of the rows, so ranges have about as many rows each, however values lie. Equal values are in one."""
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = values.groupBy(*by).agg(F.percentile_approx(column, shares, 4 * ranges).alias("_cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((ranges - 1).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= ranges - 1) & (F.get("_cuts", at + k - 1) < F.col(column)), at + k).otherwise(at))
    return same(values, cuts, by).withColumn("_range", place).drop("_cuts")


def sums_before(counts: DataFrame, column: str, by: Sequence[str], sums: Sequence[str], downwards: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds, to rows of distinct values of the column, the sums over all smaller (or greater) values in the same group, as <name>_before.

    The ranges' sums are added up in order, and within a range the values'."""
    order = F.desc if downwards else F.asc
    cut = with_range(counts, column, by, ranges)
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(order(column)).rowsBetween(Window.unboundedPreceding, -1)
    out = same(cut, totals, [*by, "_range"])
    return out.withColumns({f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop("_range", *[f"_{c}" for c in sums])


def percentiles(rows: DataFrame, column: str, points: Mapping[str, float], by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """One row for each group: the exact percentiles of the column (nulls left out), with linear interpolation between neighbours.

    Values are counted, the counts summed up by range, and only the ranges that hold a wanted rank are put in order.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    cut = with_range(counts, "_v", by, ranges)
    own = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")
    totals = cut.groupBy(*by, "_range").agg(F.sum("_n").alias("_all"))
    totals = totals.select(*by, "_range", F.sum("_all").over(own).alias("_upto"), "_all", F.sum("_all").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size"))
    rank = lambda q: F.lit(q) * (F.col("_size") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(rank(q)).cast("long").alias("at"), (rank(q) - F.floor(rank(q))).alias("share")) for name, q in points.items() for side, f in enumerate((F.floor, F.ceil))])
    first = F.col("_upto") - F.col("_all")
    held = totals.withColumn("_w", F.explode(wanted)).where((F.col("_w.at") >= first) & (F.col("_w.at") < F.col("_upto")))
    held = held.groupBy(*by, "_range").agg(F.collect_list(F.struct("_w.name", "_w.side", (F.col("_w.at") - first).alias("at"), "_w.share")).alias("_wanted"))
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = same(cut, held, [*by, "_range"]).withColumn("_end", F.sum("_n").over(inside))
    here = F.filter("_wanted", lambda w: (w["at"] < F.col("_end")) & (w["at"] >= F.col("_end") - F.col("_n")))
    found = placed.select(*by, F.col("_v").cast("double").alias("_v"), F.explode(here).alias("_w"))
    value = lambda name, side: F.max(F.when((F.col("_w.name") == name) & (F.col("_w.side") == side), F.col("_v")))
    share = lambda name: F.max(F.when(F.col("_w.name") == name, F.col("_w.share")))
    between: dict[str, Column] = {name: F.when(share(name) == 0, value(name, 0)).otherwise(value(name, 0) + (value(name, 1) - value(name, 0)) * share(name)) for name in points}
    return found.groupBy(*by).agg(*[v.alias(name) for name, v in between.items()])
