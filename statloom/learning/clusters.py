"""Clustering, its scores and two-dimensional projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.runtime import fixed, lookup

SEED = 42


def scaled_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without gaps in ``cols`` with standardised ``features``."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(df.dropna(subset=list(cols)))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(rows).transform(rows).drop("_raw")


def shifted(rows: DataFrame, by: float = 10.0) -> DataFrame:
    """Move all points by the same step.

    The top-down algorithm starts from centres a small fraction of their norm
    apart and cannot split points centred on the origin.
    """
    moved = F.transform(vector_to_array("features"), lambda x: x + F.lit(by))
    return rows.withColumn("shifted", array_to_vector(moved))


def best_kmeans(rows: DataFrame, k: int, restarts: int, threads: int = 8):
    """The model with the lowest cost over several seeds; fits are submitted side by side."""
    def fit(seed: int):
        model = KMeans(k=k, seed=seed).fit(rows)
        return model.summary.trainingCost, seed, model
    with ThreadPoolExecutor(threads) as pool:
        return min(pool.map(fit, range(SEED, SEED + restarts)), key=lambda t: t[:2])


def kmeans_sweep(rows: DataFrame, ks: Sequence[int], restarts: int = 10) -> DataFrame:
    """Inertia and silhouette (squared Euclidean) per K, the best K marked."""
    rows = rows.select("features").persist()
    try:
        found = []
        for k in ks:
            cost, _, model = best_kmeans(rows, k, restarts)
            found.append((k, float(cost), silhouette(model.transform(rows))))
    finally:
        rows.unpersist()
    top = max(found, key=lambda f: (f[2], -f[0]))[0]
    table = [(k, cost, s, k == top) for k, cost, s in found]
    return rows.sparkSession.createDataFrame(table, "k int, inertia double, silhouette double, best boolean")


def silhouette(predicted: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance, linear in the rows."""
    return float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(predicted))


def cluster_models(k: int) -> dict:
    """K-means and a top-down hierarchy (on ``shifted``); the mixture is ``diagonal_mixture``."""
    return {
        "kmeans": KMeans(k=k, seed=SEED),
        "bisecting": BisectingKMeans(k=k, seed=SEED, featuresCol="shifted"),
    }


def compare_clusterings(rows: DataFrame, k: int, dataset: str, restarts: int = 10) -> DataFrame:
    """Silhouette of each algorithm at the same K, over all features; K-means is the best of ``restarts`` seeds."""
    rows = shifted(rows.select("features")).persist()
    try:
        labelled = {
            "kmeans": best_kmeans(rows, k, restarts)[2].transform(rows),
            "bisecting": cluster_models(k)["bisecting"].fit(rows).transform(rows),
            "gaussian_mixture": mixture_members(rows, diagonal_mixture(rows, k)),
        }
        found = [(dataset, name, k, silhouette(p)) for name, p in labelled.items()]
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame(found, "dataset string, algorithm string, k int, silhouette double")


CLOSURE_NUMBERS = 4_000_000
"""Numbers (32 MB) of cluster moments or anchors that one pass hands to its tasks."""


def complete(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keep, _v): the features as one array, of the rows that have all of them.

    One column, since the optimiser's work grows steeply with filters on many.
    """
    rows = df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    return rows.where(F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v)))


def point_silhouettes(df: DataFrame, key: str, cols: Sequence[str], cluster: str) -> DataFrame:
    """Silhouette of each row under squared Euclidean distance; rows with a missing feature or cluster are left out.

    The mean squared distance to a cluster follows from its size, sum vector and sum of squared norms, so no pair of
    rows is formed. Each pass compares the rows with as many clusters as ``CLOSURE_NUMBERS`` allows and keeps
    the distance to the own and to the nearest other cluster; there are as many passes as the clusters need.
    """
    width, rows = len(cols), complete(df.dropna(subset=[cluster]), [key, cluster], cols)
    norm = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v)
    sums = F.array(*[F.sum(F.get("_v", F.lit(i))) for i in range(width)])
    moments = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("ss"), sums.alias("sums"))
    moments = fixed(moments.withColumn("number", F.row_number().over(Window.orderBy(cluster)) - 1))
    total, size = moments.count(), max(1, CLOSURE_NUMBERS // (width + 2))
    rows = lookup(rows, moments.select(cluster, F.col("number").alias("_own"), F.col("n").alias("_n")), [cluster])
    rows = rows.withColumns({"_a": F.lit(float("nan")), "_b": F.lit(float("inf"))})
    schema = rows.schema
    for start in range(0, total, size):
        part = moments.where(F.col("number").between(start, start + size - 1)).orderBy("number").toPandas()
        n, ss, sums = part["n"].to_numpy(float), part["ss"].to_numpy(float), np.vstack(part["sums"].to_numpy())

        def compare(batches: Iterator[pa.RecordBatch], start=start, n=n, ss=ss, sums=sums) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                own, a, b = (batch[c].to_numpy(zero_copy_only=False).copy() for c in ("_own", "_a", "_b"))
                for lo in range(0, len(n), 1000):
                    hi = min(lo + 1000, len(n))
                    far = np.maximum(n[lo:hi] * (x * x).sum(axis=1)[:, None] - 2 * x @ sums[lo:hi].T + ss[lo:hi], 0.0)
                    at = own - start - lo
                    mine = np.flatnonzero((at >= 0) & (at < hi - lo))
                    a[mine] = far[mine, at[mine]] / np.maximum(n[lo:hi][at[mine]] - 1, 1)
                    far = far / n[lo:hi]
                    far[mine, at[mine]] = np.inf
                    b = np.minimum(b, far.min(axis=1)) if len(far) else b
                arrays = [pa.array(a) if c == "_a" else pa.array(b) if c == "_b" else batch[c] for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        rows = rows.mapInArrow(compare, schema)
    nearest = F.when(F.col("_b") < float("inf"), F.col("_b"))
    top = F.nullif(F.greatest(F.col("_a"), nearest), F.lit(0.0))
    value = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.coalesce((nearest - F.col("_a")) / top, F.lit(0.0)))
    return rows.select(key, cluster, value.alias("silhouette"))


def anchors_of(df: DataFrame, key: str, cluster: str, most: int) -> pd.DataFrame:
    """Up to ``most`` rows of each cluster, those with the least hashes of their keys, with the cluster's size ``n``.

    A cut by the hash leaves little more than the wanted rows of a cluster before any are ranked.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64(F.lit("anchor"), key), F.lit(1 << 40))
    rows = lookup(df, sizes, [cluster]).withColumn("_place", place)
    rows = rows.where(F.col("_place") <= F.lit(float(1 << 40)) * 1.5 * (most + 20) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy("_place", key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).select(key, cluster, "n", "_v").toPandas()


def euclidean_silhouettes(df: DataFrame, key: str, cols: Sequence[str], cluster: str, anchors: int = 2000) -> DataFrame:
    """(key, cluster, silhouette, error): silhouette of each row under plain Euclidean distance.

    Mean distances have no short form here, so every row is compared, in blocks, with up to ``anchors`` rows of every cluster, drawn by
    a hash of the key, which all tasks get (fewer each if they would be more than ``CLOSURE_NUMBERS`` numbers). Clusters
    no larger than that are compared whole; if all are, the result is exact and ``error`` is 0. Else ``error`` is the standard error of the
    value, from the spread of the distances to the anchors. Rows with a missing feature or cluster are left out.
    """
    width, rows = len(cols), complete(df.dropna(subset=[cluster]), [key, cluster], cols)
    clusters = rows.select(cluster).distinct().count()
    most = max(2, min(anchors, CLOSURE_NUMBERS // max(1, clusters * width)))
    held = anchors_of(rows, key, cluster, most).sort_values([cluster, key])
    names = list(held[cluster].unique())
    groups = [held[held[cluster] == c] for c in names]
    points, keys = [np.vstack(g["_v"].to_numpy()) for g in groups], [set(g[key]) for g in groups]
    sizes, number = [int(g["n"].iloc[0]) for g in groups], {c: i for i, c in enumerate(names)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            own = np.array([number[c] for c in batch[cluster].to_pylist()], int)
            sums, squares = np.zeros((len(x), len(points))), np.zeros((len(x), len(points)))
            for j, p in enumerate(points):
                for lo in range(0, len(p), 32):
                    far = np.sqrt(((x[:, None, :] - p[None, lo : lo + 32, :]) ** 2).sum(axis=2))
                    sums[:, j] += far.sum(axis=1)
                    squares[:, j] += (far * far).sum(axis=1)
            counts = np.array([len(p) for p in points], float)[None, :].repeat(len(x), axis=0)
            itself = np.array([k in keys[o] for k, o in zip(batch[key].to_pylist(), own)], bool)
            at = np.arange(len(x))
            counts[at[itself], own[itself]] -= 1
            safe = np.maximum(counts, 1)
            mean = sums / safe
            spread = np.maximum(squares / safe - mean * mean, 0) / safe
            spread[:, [len(p) == n for p, n in zip(points, sizes)]] = 0
            a, va = mean[at, own], spread[at, own]
            mean[at, own] = np.inf
            near = mean.argmin(axis=1) if mean.size else np.zeros(0, int)
            b, vb = mean[at, near], spread[at, near]
            top = np.maximum(a, b)
            lone = (np.array(sizes)[own] == 1) | ~np.isfinite(b) | (top == 0)
            top = np.where(lone, 1.0, top)
            value = np.where(lone, 0.0, (np.where(lone, 0, b) - a) / top)
            error = np.where(lone, 0.0, np.sqrt(va + vb) / top)
            yield pa.RecordBatch.from_arrays([batch[key], batch[cluster], pa.array(value), pa.array(error)], names=[key, cluster, "silhouette", "error"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, cluster)]
    return rows.mapInArrow(score, f"{', '.join(kinds)}, silhouette double, error double")


@dataclass
class Mixture:
    """Gaussian mixture with diagonal covariances."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float

    def memberships(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function of rows: the share of each component in each row, and the log density of each row."""
        weights, means, variances = self.weights, self.means, self.variances

        def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            far = ((x[:, None, :] - means[None]) ** 2 / variances[None] + np.log(2 * np.pi * variances)[None]).sum(axis=2)
            logs = np.log(weights)[None] - 0.5 * far
            top = logs.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
            return np.exp(logs - total), total[:, 0]

        return run


def diagonal_mixture(rows: DataFrame, k: int, iterations: int = 100, tolerance: float = 1e-4, floor: float = 1e-3) -> Mixture:
    """Expectation maximisation over all ``features``, from the centres of K-means.

    Each round is one pass: tasks add up shares, sums and squares of their rows, and only those sums meet. Rounds end when the mean log density moves by at most ``tolerance``. Variances do not fall below
    ``floor`` of the whole table's, which keeps a component from closing on a few rows in many dimensions.
    """
    data = fixed(rows.select(vector_to_array("features").alias("x")))
    centres = np.vstack(KMeans(k=k, seed=SEED).fit(rows).clusterCenters())
    size = centres.shape[1]

    def totals(model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
        share = model.memberships()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, q, logs, held = np.zeros(k), np.zeros((k, size)), np.zeros((k, size)), 0.0, 0
            for batch in batches:
                if len(batch):
                    x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    r, log = share(x)
                    n, s, q, logs, held = n + r.sum(axis=0), s + r.T @ x, q + r.T @ (x * x), logs + log.sum(), held + len(x)
            values = np.concatenate([n, s.ravel(), q.ravel(), [logs, held]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["i", "v"])

        found = data.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        n, s, q = found[:k], found[k : k + k * size].reshape(k, size), found[k + k * size : k + 2 * k * size].reshape(k, size)
        return n, s, q, float(found[-2]), int(found[-1])

    flat = Mixture(np.full(k, 1 / k), centres, np.ones((k, size)), -np.inf)
    n, s, q, _, held = totals(flat)
    whole = np.maximum(q.sum(axis=0) / held - (s.sum(axis=0) / held) ** 2, 1e-12)
    model, before = Mixture(flat.weights, centres, np.tile(whole, (k, 1)), -np.inf), -np.inf
    for _ in range(iterations):
        n, s, q, logs, held = totals(model)
        safe = np.maximum(n, 1e-12)[:, None]
        means = s / safe
        variances = np.maximum(q / safe - means * means, floor * whole)
        model = Mixture(np.maximum(n, 1e-12) / held, means, variances, logs)
        if abs(logs - before) <= tolerance * held:
            break
        before = logs
    return model


def mixture_members(rows: DataFrame, model: Mixture) -> DataFrame:
    """Add ``prediction``, the component with the largest share in each row, and ``membership``, that share."""
    share = model.memberships()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            r = share(np.vstack(x.to_numpy()))[0] if len(x) else np.zeros((0, 1))
            yield pd.DataFrame({"prediction": r.argmax(axis=1).astype(np.int32), "membership": r.max(axis=1) if len(r) else []})

    found = F.pandas_udf(run, "prediction int, membership double")(vector_to_array("features"))
    return rows.withColumn("_m", found).withColumns({"prediction": F.col("_m.prediction"), "membership": F.col("_m.membership")}).drop("_m")


def profile(df: DataFrame, cluster: str, cols: Sequence[str], positive: Column | None = None) -> DataFrame:
    """Size, mean of each feature and share of a class per cluster."""
    extra = [(F.avg(F.coalesce(positive, F.lit(False)).cast("double")) * 100).alias("share_percent")] if positive is not None else []
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n"), *extra)


def pca(rows: DataFrame, key: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """First k components of each row and the share of variance each explains."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(rows)
    parts = vector_to_array("_pc")
    table = model.transform(rows).select(key, *[F.get(parts, i).alias(f"pc{i + 1}") for i in range(k)])
    return table, [float(v) for v in model.explainedVariance.toArray()]
