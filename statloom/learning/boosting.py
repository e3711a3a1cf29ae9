"""Gradient boosting with second-order trees, grown level by level from histograms.

Each row keeps its features as bin numbers and its current score. For a level of a tree, one grouped aggregate adds the
gradients and Hessians of the loss by (node, feature, bin); nothing else about the rows is needed to choose all splits
of the level, so the driver sees at most nodes * features * bins sums, whatever the number of rows. A split must gain at least
``gamma`` and leave both sides a Hessian of ``min_child_weight``; weights are shrunk by ``reg_lambda``.

Bins are the distinct values of a feature where it has at most ``max_bins``, so splits are then exact; else
its approximate quantiles. Missing values and NaN lie below every value and go left. Rows without a label are left out of the fit.
Scores are cut off from their lineage by a checkpoint every few trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.runtime import fixed

CHECKPOINT_TREES = 8
"""Trees added to the scores between two checkpoints."""


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    depth: int = 5
    rate: float = 0.05
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_bins: int = 256
    loss: str = "squared"
    base: float | None = None
    """Score before the first tree; by default the mean label, or its log odds."""


@dataclass
class Node:
    """A leaf has no feature. ``cut`` is a bin, ``threshold`` the largest value that goes left."""

    number: int
    weight: float
    rows: int
    gain: float | None = None
    feature: int | None = None
    cut: int | None = None
    threshold: float | None = None


@dataclass
class Boosted:
    features: list[str]
    settings: Settings
    base: float
    trees: list[dict[int, Node]] = field(default_factory=list)

    def importances(self) -> dict[str, float]:
        """Share of the total gain by feature."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for n in tree.values():
                if n.feature is not None:
                    gains[self.features[n.feature]] += n.gain
        total = sum(gains.values())
        return {f: g / total if total else 0.0 for f, g in gains.items()}

    def score(self) -> Column:
        """The score of a row, by an Arrow-batched function over all trees at once."""
        size, rate, base = 2 ** (self.settings.depth + 1), self.settings.rate, self.base
        feature = np.zeros((len(self.trees), size), np.int64)
        threshold = np.full((len(self.trees), size), np.inf)
        weight = np.zeros((len(self.trees), size))
        for t, tree in enumerate(self.trees):
            for n in tree.values():
                feature[t, n.number], threshold[t, n.number] = n.feature or 0, np.inf if n.threshold is None else n.threshold
                weight[t, n.number] = n.weight
            for at in range(2, size):
                if at not in tree and at // 2 not in {n.number for n in tree.values() if n.feature is not None}:
                    weight[t, at] = weight[t, at // 2]
        depth = self.settings.depth

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for columns in batches:
                x = columns.to_numpy(float, na_value=np.nan)
                x = np.where(np.isnan(x), -np.inf, x)
                out, rows = np.full(len(x), base), np.arange(len(x))
                for t in range(len(feature)):
                    at = np.ones(len(x), np.int64)
                    for _ in range(depth):
                        at = 2 * at + (x[rows, feature[t, at]] > threshold[t, at])
                    out += rate * weight[t, at]
                yield pd.Series(out)

        udf = F.pandas_udf(run, "double")
        return udf(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        """Add the predicted value, or the probability of label 1 under the logistic loss."""
        score = self.score()
        return df.withColumn(into, score if self.settings.loss == "squared" else 1 / (1 + F.exp(-score)))

    def table(self) -> list[tuple]:
        """(tree, node, feature, threshold, gain, weight, rows) of every node."""
        return [
            (t, n.number, None if n.feature is None else self.features[n.feature], n.threshold, n.gain, n.weight, n.rows)
            for t, tree in enumerate(self.trees)
            for n in sorted(tree.values(), key=lambda n: n.number)
        ]


TREE_TABLE = "tree int, node int, feature string, threshold double, gain double, weight double, n long"


def bin_edges(df: DataFrame, features: Sequence[str], most: int) -> list[list[float]]:
    """Upper values of the bins of each feature but its last."""
    out = []
    for f in features:
        x = F.col(f).cast("double")
        known = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
        values = [r["x"] for r in known.distinct().limit(most + 1).collect()]
        if len(values) > most:
            probs = [i / most for i in range(1, most)]
            values = known.agg(F.percentile_approx("x", probs, 20 * most).alias("q")).first()["q"] + [float("inf")]
        out.append(sorted(set(values))[:-1])
    return out


def slopes(loss: str, label: Column, score: Column) -> tuple[Column, Column]:
    """Gradient and Hessian of the loss at the score."""
    if loss == "squared":
        return score - label, F.lit(1.0)
    if loss == "logistic":
        p = 1 / (1 + F.exp(-score))
        return p - label, p * (1 - p)
    raise ValueError(f"unknown loss {loss}")


def routed(tree: dict[int, Node], at: int = 1) -> Column:
    """The leaf number of a row, from its bins."""
    n = tree[at]
    if n.feature is None:
        return F.lit(at)
    return F.when(F.get("bins", F.lit(n.feature)) <= n.cut, routed(tree, 2 * at)).otherwise(routed(tree, 2 * at + 1))


def leaf_weight(tree: dict[int, Node], at: int = 1) -> Column:
    n = tree[at]
    if n.feature is None:
        return F.lit(n.weight)
    return F.when(F.get("bins", F.lit(n.feature)) <= n.cut, leaf_weight(tree, 2 * at)).otherwise(leaf_weight(tree, 2 * at + 1))


def histograms(rows: DataFrame, tree: dict[int, Node]) -> pd.DataFrame:
    """Sums of gradients, Hessians and rows by (node, feature, bin) at the leaves that may still split."""
    parts = rows.select(routed(tree).alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).toPandas()


def best_split(node: pd.DataFrame, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node; of equal gains the first feature and least bin."""
    best = None
    for f, part in sorted(node.groupby("feature")):
        part = part.sort_values("bin")
        g, h = part["g"].to_numpy(), part["h"].to_numpy()
        total_g, total_h = g.sum(), h.sum()
        left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        value = lambda a, b: a * a / (b + s.reg_lambda)
        gain = value(left_g, left_h) + value(right_g, right_h) - value(total_g, total_h)
        gain = np.where((left_h >= s.min_child_weight) & (right_h >= s.min_child_weight), gain, -np.inf)
        if len(gain) and gain.max() > s.gamma and (best is None or gain.max() > best[0]):
            at = int(gain.argmax())
            best = float(gain[at]), int(f), int(part["bin"].iloc[at])
    return best


def grow(rows: DataFrame, edges: list[list[float]], s: Settings) -> dict[int, Node]:
    """One tree on rows with ``bins``, ``g`` and ``h``."""
    tree, open_nodes = {1: Node(1, 0.0, 0)}, {1}
    for level in range(s.depth + 1):
        found = histograms(rows, tree)
        for number, node in found[found["node"].isin(open_nodes)].groupby("node"):
            one = node[node["feature"] == 0]
            tree[number] = Node(int(number), -float(one["g"].sum() / (one["h"].sum() + s.reg_lambda)), int(one["n"].sum()))
            split = best_split(node, s) if level < s.depth else None
            if split:
                n = tree[number]
                n.gain, n.feature, n.cut = split
                n.threshold = edges[n.feature][n.cut - 1] if n.cut > 0 else -np.inf
        open_nodes = {c for i in open_nodes if tree[i].feature is not None for c in (2 * i, 2 * i + 1)}
        for i in open_nodes:
            tree[i] = Node(i, 0.0, 0)
        if not open_nodes:
            break
    return tree


def fit(df: DataFrame, features: Sequence[str], label: str, settings: Settings = Settings()) -> Boosted:
    """Fit a boosted model on the rows that have a label."""
    s, features = settings, list(features)
    y = F.col(label).cast("double")
    df = fixed(df.where(y.isNotNull() & ~F.isnan(y)).select(*[F.col(f).cast("double").alias(f) for f in features], y.alias("label")))
    edges = bin_edges(df, features, s.max_bins)
    base = s.base
    if base is None:
        mean = df.agg(F.avg("label")).first()[0] or 0.0
        base = mean if s.loss == "squared" else float(np.log(np.clip(mean, 1e-9, 1 - 1e-9) / (1 - np.clip(mean, 1e-9, 1 - 1e-9))))
    model = Boosted(features, s, float(base))

    def bin_of(f: str, upper: list[float]) -> Column:
        # 0 for missing values, else one more than the number of bins below.
        value = F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f)), F.col(f))
        below = F.size(F.filter(F.array(*[F.lit(e) for e in upper]).cast("array<double>"), lambda e: e < value))
        return F.when(value.isNull(), F.lit(0)).otherwise(below + 1)

    rows = fixed(df.select("label", F.array(*[bin_of(f, e) for f, e in zip(features, edges)]).alias("bins")).withColumn("score", F.lit(model.base)))
    for number in range(s.trees):
        g, h = slopes(s.loss, F.col("label"), F.col("score"))
        tree = grow(rows.withColumns({"g": g, "h": h}), edges, s)
        model.trees.append(tree)
        rows = rows.withColumn("score", F.col("score") + s.rate * leaf_weight(tree))
        if number % CHECKPOINT_TREES == CHECKPOINT_TREES - 1:
            rows = fixed(rows)
    return model
