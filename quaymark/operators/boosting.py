"""Gradient boosting on histograms: tasks sum gradients by feature and bin, Spark adds the tasks' sums up, and the driver sees one number for each cell. For a number, or for classes by softmax."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.sources.tables import stored

from .ranks import percentiles

#: Gradients are summed as whole numbers of 2^-24, so sums don't depend on the order of rows or tasks.
UNIT = float(1 << 24)


@dataclass
class Tree:
    """A full binary tree: node i goes to 2i + 1, or to 2i + 2 if the feature's bin is above the cut. A node without a gain sends all to the first."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf_values(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        while len(node) and node[0] < len(self.feature):
            node = 2 * node + 1 + (bins[np.arange(len(bins)), self.feature[node]] > self.cut[node])
        return self.value[node - len(self.feature)]


@dataclass
class Boosted:
    """rounds: in each a tree for every output. classes 0 is a regression."""

    features: list[str]
    edges: np.ndarray
    classes: int
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def first(self, k: int) -> Boosted:
        """The model of its first k rounds."""
        return Boosted(self.features, self.edges, self.classes, self.start, self.rounds[:k])

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Of each value the number of edges below it; missing values are below all."""
        out = np.stack([np.searchsorted(self.edges[k], x[:, k], side="left") for k in range(len(self.features))], axis=1)
        return np.where(np.isnan(x), 0, out).astype(np.int64)

    def staged(self, bins: np.ndarray) -> Iterator[np.ndarray]:
        """Scores of each row before the first round and after each."""
        scores = np.tile(self.start, (len(bins), 1))
        yield scores
        for trees in self.rounds:
            scores = scores + np.stack([t.leaf_values(bins) for t in trees], axis=1)
            yield scores

    def scores(self, bins: np.ndarray) -> np.ndarray:
        for out in self.staged(bins):
            last = out
        return last


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _edges(rows: DataFrame, features: Sequence[str], bins: int) -> np.ndarray:
    """The features' quantiles, exact; one row a feature reaches the driver."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]))
    long = rows.select(cells.alias("c")).select("c.*").where("v is not null and not isnan(v)")
    points = {f"q{k}": k / bins for k in range(1, bins)}
    out = np.full((len(features), bins - 1), np.inf)
    for r in percentiles(long, "v", points, ["feature"]).collect():
        out[r.feature] = [r[p] for p in points]
    return out


def _gradients(model: Boosted, bins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = model.scores(bins)
    if not model.classes:
        return scores - y[:, None], np.ones_like(scores)
    p = softmax(scores)
    return p - (y[:, None] == np.arange(model.classes)), p * (1 - p)


def _sums(table: DataFrame, model: Boosted, trees: list[Tree], width: int) -> dict[tuple[int, int], np.ndarray]:
    """(output, node) -> sums of gradients, curvatures and rows by feature and bin, of the nodes that the trees so far lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            bins = batch.column(1).flatten().to_numpy().reshape(len(y), -1).astype(np.int64)
            g, h = (np.rint(x * UNIT) for x in _gradients(model, bins, y))
            for c, tree in enumerate(trees):
                node = np.zeros(len(y), np.int64)
                for _ in range(int(np.log2(len(tree.feature) + 1))):
                    node = 2 * node + 1 + (bins[np.arange(len(y)), tree.feature[node]] > tree.cut[node])
                for k in range(bins.shape[1]):
                    cell = node * width + bins[:, k]
                    n = int(cell.max()) + 1
                    found = np.stack([np.bincount(cell, w, n).astype(np.int64) for w in (g[:, c], h[:, c], np.ones(len(y)))])
                    for at in np.unique(node):
                        part = np.zeros((3, width), np.int64)
                        got = found[:, at * width : (at + 1) * width]
                        part[:, : got.shape[1]] = got
                        key = (c, int(at), k)
                        total[key] = total[key] + part if key in total else part
        cells = [(*key, b, *map(int, part[:, b])) for key, part in total.items() for b in range(width) if part[2, b]]
        columns = list(zip(*cells)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["output", "node", "feature", "bin", "g", "h", "n"])

    cells = table.mapInArrow(run, "output long, node long, feature long, bin long, g long, h long, n long")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in cells.groupBy("output", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
        out.setdefault((r.output, r.node), np.zeros((len(model.features), width, 3)))[r.feature, r.bin] = (r.g / UNIT, r.h / UNIT, r.n)
    return out


def _best_cut(sums: np.ndarray, penalty: float, least_rows: int) -> tuple[int, int]:
    """The (feature, bin) of the greatest gain, the first at ties; (0, all bins) without one."""
    left = np.cumsum(sums, axis=1)
    right = left[:, -1:, :] - left
    part = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = part(left) + part(right) - part(left[:, -1:, :])
    gain[(left[..., 2] < least_rows) | (right[..., 2] < least_rows)] = 0
    at = int(np.argmax(gain))
    return divmod(at, sums.shape[1]) if gain.flat[at] > 1e-12 else (0, sums.shape[1])


def boosted(rows: DataFrame, features: Sequence[str], label: str, classes: int = 0, rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, penalty: float = 1.0, least_rows: int = 20) -> Boosted:
    """classes 0: squared error of a number; else log loss of classes 0, 1, ... The model depends on the rows alone, not on their order or partitions. Rows without a label are left out.

    A pass over the binned rows for each level of a round; what reaches the driver is bounded by outputs * 2^depth * features * bins.
    """
    rows = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = stored(rows, "boosting-rows")
    edges = _edges(rows, features, bins)
    if classes:
        shares = {int(r["_y"]): r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
        start = np.log([(shares.get(k, 0) + 1) / (sum(shares.values()) + classes) for k in range(classes)])
    else:
        start = np.array([float(rows.agg(F.avg(F.col("_y").cast("decimal(30,12)"))).first()[0] or 0)])
    model = Boosted(list(features), edges, classes, start)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))], axis=1)
            b = model.bins(x).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(features)), pa.array(b.ravel()))], names=["_y", "bins"])

    table = stored(rows.mapInArrow(binned, "_y double, bins array<int>"), "boosting-bins")
    outputs = max(classes, 1)
    for _ in range(rounds):
        trees = [Tree(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in range(outputs)]
        for level in range(depth):
            sums = _sums(table, model, trees, bins)
            for c, tree in enumerate(trees):
                cuts = [_best_cut(sums[c, node], penalty, least_rows) if (c, node) in sums else (0, bins) for node in range((1 << level) - 1, (2 << level) - 1)]
                tree.feature = np.append(tree.feature, [f for f, _ in cuts]).astype(np.int64)
                tree.cut = np.append(tree.cut, [b for _, b in cuts]).astype(np.int64)
                if level == depth - 1:
                    tree.value = np.zeros(1 << depth)
                    for i, (f, b) in enumerate(cuts):
                        if (at := sums.get((c, i + (1 << level) - 1))) is not None:
                            for side, part in enumerate((at[f, : b + 1], at[f, b + 1 :])):
                                g, h, n = part.sum(axis=0)
                                tree.value[2 * i + side] = -rate * g / (h + penalty) if n else 0.0
        model.rounds.append(trees)
    return model


def predicted(model: Boosted, rows: DataFrame, name: str = "p") -> DataFrame:
    """Rows with the predicted number, or with the likeliest class and the classes' probabilities."""
    x = F.array(*[F.col(f).cast("double") for f in model.features])
    kind = "array<double>" if model.classes else "double"

    @F.pandas_udf(kind)
    def score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object if model.classes else float)
        out = model.scores(model.bins(np.array([[np.nan if v is None else v for v in row] for row in values], float)))
        return pd.Series(list(softmax(out)) if model.classes else out[:, 0])

    if not model.classes:
        return rows.withColumn(name, score(x))
    out = rows.withColumn("probabilities", score(x))
    return out.withColumn(name, (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))


def staged_losses(model: Boosted, rows: DataFrame, label: str) -> list[float]:
    """The mean loss (squared error, or log loss) before the first round and after each, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(model.rounds) + 1, object), 0
        for batch in batches:
            if len(batch):
                y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(model.features))], axis=1)
                n += len(y)
                for k, s in enumerate(model.staged(model.bins(x))):
                    each = -np.log(softmax(s)[np.arange(len(y)), y.astype(int)]) if model.classes else (s[:, 0] - y) ** 2
                    sums[k] += int(np.rint(each * 2.0**40).astype(object).sum())
        yield pa.RecordBatch.from_pydict({"k": list(range(len(sums))), "loss": pa.array([float(s) / 2.0**40 for s in sums], pa.float64()), "n": [n] * len(sums)})

    cells = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double"), *[F.col(f).cast("double") for f in model.features]).mapInArrow(run, "k long, loss double, n long")
    return [r.loss for r in cells.groupBy("k").agg((F.sum("loss") / F.sum("n")).alias("loss")).orderBy("k").collect()]
