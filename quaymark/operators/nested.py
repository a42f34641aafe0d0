"""Nested selection: an inner year picks horizon and threshold, the next year is traded with what was picked. Scores come from a model that is fitted inside, or from a fixed rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, simulate, splits

#: (rows, horizon, year, rounds) -> the year's rows with `score`, and the rounds of the model (None: no model).
Scorer = Callable[[DataFrame, int, int, "int | None"], "tuple[DataFrame, int | None]"]


def target(horizon: int) -> str:
    return f"future_return_{horizon}m"


def rule(score: Column) -> Scorer:
    """Scores that need no training."""
    return lambda rows, horizon, year, rounds: (rows.where(F.col("year") == year).withColumn("score", score), None)


def boosted_scores(features: Sequence[str], step_ms: int, rounds: int = 20, **options) -> Scorer:
    """Boosted regressions of a horizon's return on all years before, purged of labels that end in the year. Without given rounds, the year's own loss after each round
    tells how many are best; that number is frozen for the outer fit."""

    def score(rows: DataFrame, horizon: int, year: int, frozen: int | None) -> tuple[DataFrame, int | None]:
        before = rows.where((F.col("ts_ms") + horizon * step_ms < splits.year_start(F.lit(year))))
        this = rows.where(F.col("year") == year)
        model = boosting.boosted(before, features, target(horizon), rounds=frozen or rounds, **options)
        if frozen is None:
            losses = boosting.staged_losses(model, this, target(horizon))
            frozen = max(1, losses.index(min(losses)))
            model = model.first(frozen)
        return boosting.predicted(model, this, "score"), frozen

    return score


def _results(scored: dict[int, DataFrame], thresholds: Sequence[float], costs: Sequence[float], step_ms: int) -> DataFrame:
    """Statistics of the trades of each outer_year, horizon, threshold and cost."""
    signals = []
    for h, rows in scored.items():
        each = rows.withColumns({"horizon": F.lit(h), "exit_ms": F.col("ts_ms") + h * step_ms, "y": F.col(target(h))}).where("y is not null")
        signals.append(simulate.threshold_signals(each.select("outer_year", "instrument", "horizon", "ts_ms", "exit_ms", "y", "score"), "score", thresholds))
    keys = ["outer_year", "horizon", "threshold"]
    trades = simulate.non_overlapping(reduce(DataFrame.unionByName, signals), ["instrument", *keys]).withColumn("gross", F.col("side") * F.col("y"))
    return simulate.equity(simulate.with_costs(trades, costs), [*keys, "cost_bps"])


def nested_selection(rows: DataFrame, scorer: Scorer, horizons: Sequence[int], outer_years: Sequence[int], thresholds: Sequence[float], costs: Sequence[float], step_ms: int, inner_cost: float = 2.0, least_trades: int = 5) -> DataFrame:
    """One row for each outer year and cost: what its inner year (the one before) picked, and the statistics of the outer year's trades with it.

    rows: instrument, ts_ms, year, features and the horizons' targets. The fits of all inner years and horizons run side by side, then those of the outer years, each with its
    inner fit's rounds. Picked is the horizon and threshold of the greatest compound return at inner_cost (then more trades, the shorter horizon, the lower threshold) among those with
    least_trades; an outer year without one has no row.
    """
    cells = [(y, h) for y in outer_years for h in horizons]

    def side_by_side(tasks: list[tuple[int, int, int, int | None]]) -> list[tuple[DataFrame, int | None]]:
        run = inheritable_thread_target(rows.sparkSession)(lambda task: scorer(rows, task[1], task[2], task[3]))
        with ThreadPoolExecutor(max(1, min(len(tasks), 8))) as pool:
            return list(pool.map(run, tasks))

    def gathered(scored: list[tuple[DataFrame, int | None]]) -> dict[int, DataFrame]:
        tagged: dict[int, list[DataFrame]] = {}
        for (y, h), (df, _) in zip(cells, scored):
            tagged.setdefault(h, []).append(df.withColumn("outer_year", F.lit(y)))
        return {h: reduce(DataFrame.unionByName, parts) for h, parts in tagged.items()}

    inner = side_by_side([(y, h, y - 1, None) for y, h in cells])
    outer = side_by_side([(y, h, y, rounds) for (y, h), (_, rounds) in zip(cells, inner)])
    inner_results = _results(gathered(inner), thresholds, [inner_cost], step_ms)
    outer_results = _results(gathered(outer), thresholds, costs, step_ms)
    order = [F.desc("compound_return"), F.desc("trades"), F.col("horizon"), F.col("threshold")]
    return splits.nested(inner_results, outer_results, ["outer_year"], ["horizon", "threshold"], order, F.col("trades") >= least_trades)
