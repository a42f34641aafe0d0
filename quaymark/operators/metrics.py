"""Scores of predictions as aggregates. Columns: y (truth), p (prediction or probability); everything undefined is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.columns import decile

from .ranks import percentiles, same, sums_before


def regression(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    hit = F.signum(p) == F.signum(y)
    mse, zero = F.avg((p - y) * (p - y)), F.avg(y * y)
    out = {
        "n": F.count("*"), "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(p - y)), "zero_mse": zero, "mean_mse": F.var_pop("y"), "improvement_pct": 100 * (1 - F.try_divide(mse, zero)),
        "correlation": F.when((F.stddev_pop("y") > 0) & (F.stddev_pop("p") > 0), F.corr("y", "p")), "direction": F.avg(hit.cast("double")),
        "direction_moved": F.avg(F.when(y != 0, hit.cast("double"))), "direction_called": F.avg(F.when(p != 0, hit.cast("double"))),
    }
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def summary(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    plain = rows.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    both = same(plain, percentiles(rows, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by), by, "left" if by else "inner")
    return both.select(*by, "mean", "std", "min", "q25", "q50", "q75", "max")


def distribution(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    points = {f"p{x}": x / 100 for x in (1, 5, 10, 25, 50, 75, 90, 95, 99)}
    share = lambda c: (100.0 * F.avg(c.cast("double")))
    c = F.col(column)
    plain = rows.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), share(c > 0).alias("up_pct"), share(c < 0).alias("down_pct"), share(c == 0).alias("flat_pct"))
    return same(plain, percentiles(rows, column, points, by), by, "left" if by else "inner")


def confusion(rows: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row for each pair of labels, absent pairs as 0."""
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).drop("id")
    every = F.explode(F.array(*[F.lit(k) for k in labels]))
    grid = groups.withColumn("y", every).withColumn("p", every)
    return grid.join(rows.groupBy(*by, "y", "p").agg(F.count("*").alias("n")), [*by, "y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification(rows: DataFrame, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced accuracy (over the classes that occur), macro F1, and precision, recall and F1 of each class (0 where undefined)."""
    out = {"n": F.count("*"), "accuracy": F.avg((F.col("y") == F.col("p")).cast("double"))}
    f1s, recalls, present = [], [], []
    for k in labels:
        tp, true, called = F.count_if((F.col("y") == k) & (F.col("p") == k)), F.count_if(F.col("y") == k), F.count_if(F.col("p") == k)
        out[f"precision_{k}"] = F.coalesce(F.try_divide(tp, called), F.lit(0.0))
        out[f"recall_{k}"] = F.coalesce(F.try_divide(tp, true), F.lit(0.0))
        out[f"f1_{k}"] = F.coalesce(F.try_divide(2 * tp, true + called), F.lit(0.0))
        f1s.append(out[f"f1_{k}"])
        recalls.append(out[f"recall_{k}"])
        present.append((true > 0).cast("int"))
    out["macro_f1"] = sum(f1s, F.lit(0.0)) / len(labels)
    out["balanced_accuracy"] = F.try_divide(sum(recalls, F.lit(0.0)), sum(present, F.lit(0)))
    return rows.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def class_shares(rows: DataFrame, called: str, by: Sequence[str] = ()) -> DataFrame:
    """The number of rows of each called class, and its percentage of the group."""
    counts = rows.groupBy(*by, called).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def coverage(rows: DataFrame, flat: int = 1, by: Sequence[str] = ()) -> DataFrame:
    called = F.col("p") != flat
    return rows.groupBy(*by).agg(F.avg(called.cast("double")).alias("coverage"), F.avg(F.when(called & (F.col("y") != flat), (F.col("y") == F.col("p")).cast("double"))).alias("direction"))


def roc_auc(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with mid-ranks for ties, from counts per distinct score."""
    counts = rows.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    return sums_before(counts, "p", by, ["neg"]).withColumn("_won", won).groupBy(*by).agg(F.try_divide(F.sum("_won"), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def average_precision(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The step sum of precision times the gain of recall, over distinct scores from the highest."""
    counts = rows.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n"))
    step = F.col("pos") * (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return sums_before(counts, "p", by, ["pos", "n"], downwards=True).withColumn("_s", step).groupBy(*by).agg(F.try_divide(F.sum("_s"), F.sum("pos")).alias("average_precision"))


def brier(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The mean squared error of probabilities, added up with twelve decimals, exactly, so it doesn't depend on the order of rows."""
    error = ((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).cast("decimal(26,12)")
    return rows.groupBy(*by).agg((F.sum(error).cast("double") / F.count(error)).alias("brier"))


def calibration(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean probability and rate of each decile. Probabilities are added up with nine decimals, exactly, so the mean doesn't depend on their order."""
    mean = F.sum(F.col("p").cast("decimal(20,9)")).cast("double") / F.count("p")
    return rows.withColumn("bin", decile(F.col("p"))).groupBy(*by, "bin").agg(F.count("*").alias("n"), mean.alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def feature_auc(rows: DataFrame, features: Sequence[str], by: Sequence[str] = (), least_rows: int = 100) -> DataFrame:
    """The univariate AUC of each feature for y in 0, 1, with advantage abs(auc - 0.5) and sign; too few rows or one class: none."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("p")) for f in features]))
    long = rows.withColumn("_c", cells).select(*by, "y", "_c.feature", "_c.p").where("p is not null and y in (0, 1)")
    out = roc_auc(long, [*by, "feature"]).where((F.col("n_pos") + F.col("n_neg") >= least_rows) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return out.withColumns({"advantage": F.abs(F.col("auc") - 0.5), "sign": F.when(F.col("auc") >= 0.5, 1).otherwise(-1)})


def top_features(aucs: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("advantage"), "feature")
    return aucs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def scaler(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each feature, fitted on these rows alone."""
    return rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def scaled(rows: DataFrame, fitted: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    both = rows.join(fitted, list(by)) if by else rows.crossJoin(F.broadcast(fitted))
    return both.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in features}).select(*rows.columns)
