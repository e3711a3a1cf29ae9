"""Whitening of embedding vectors by a covariance weighted with multiplicities.

1. Each entry c of a vector becomes the whole number floor(64 * c) + 1,000,000. Equal x vectors are
   grouped with their count, so a vector that a third of the table holds is one row from here on.
2. Sums S and the number n of fitted vectors come from the distinct vectors and their weights: ``counts`` fits every vector of the
   table, ``one`` every distinct vector once. Sums are whole numbers and exact.
3. The covariance is a weighted centred matrix product: each task centres its vectors, (n * x - S) / n with an exact
   numerator, multiplies them with their weights and hands on one upper triangle; triangles are added by position.
4. Its eigenvectors (a matrix as wide as a vector, on the driver; numbered by falling eigenvalue, the largest entry positive) whiten each distinct vector
   once. The covariance of the whitened vectors, taken the same way, must be the identity; its largest error is returned.
5. Whitened vectors join back to the rows. The vectors that more than one in ``HOT`` rows holds, fewer than ``HOT``, are
   broadcast; the others meet by a shuffle.

Rows whose vector is null, or holds a null, a non-finite entry or one beyond 2 ** 52, are dropped, and so are vectors of another
length than the most frequent one (of equally frequent lengths the longer counts). Components without variance beyond rounding are left out, so a table
without any (one row, equal rows, empty) gives no rows. Null keys and repeated rows are rows like others. ``deviation`` is null
beyond a long. Only the key and the vector are read, so names never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.tables import arrow, written

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 52)
HOT = 1024


def whole_numbers(vector: Column) -> Column:
    """x of a vector, null where the vector is left out."""
    entries = vector.cast("array<double>")
    sound = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    return F.when(sound, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch[column]
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def sums(df: DataFrame, column: str, weight: str) -> tuple[int, np.ndarray, float]:
    """Sum of the weights, weighted sum of each entry, and the largest absolute entry."""
    kind = df.schema[column].dataType.elementType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, largest = None, 0, 0.0
        for batch in batches:
            if len(batch):
                values, w = matrix(batch, column), batch[weight].to_numpy(zero_copy_only=False)
                part = w.astype(values.dtype) @ values
                total, n, largest = part if total is None else total + part, n + int(w.sum()), max(largest, float(np.abs(values).max()))
        if total is not None:
            size = len(total)
            arrays = [pa.array(range(size), pa.int32()), pa.array(total), pa.array([n] * size, pa.int64()), pa.array([largest] * size)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "s", "n", "largest"])

    rows = arrow(df.select(column, weight), add, f"i int, s {kind}, n long, largest double").groupBy("i")
    found = rows.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy("i").collect()
    return (found[0]["n"], np.array([r["s"] for r in found]), max(r["largest"] for r in found)) if found else (0, np.zeros(0), 0.0)


def covariance(df: DataFrame, column: str, weight: str, n: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted covariance, divisor n, of vectors that ``centred`` moves to the mean before they are multiplied."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                values, w = centred(matrix(batch, column)), batch[weight].to_numpy(zero_copy_only=False).astype(float)
                part = (values * w[:, None]).T @ values
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    parts = arrow(df.select(column, weight), multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (parts[c].to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((int(j.max()) + 1,) * 2) if len(v) else np.zeros((0, 0))
    out[i, j] = out[j, i] = v / n
    return out


@dataclass
class Whitening:
    """Fitted sums and components: ``axes`` holds one component a row, ``values`` the eigenvalues."""

    n: int
    sums: np.ndarray
    largest: float
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs if they hold it, else in Python's whole numbers."""
        if self.n * (self.largest + 1) < 2**62:
            return self.n * x - self.sums[None, :]
        return self.n * x.astype(object) - self.sums.astype(object)[None, :]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        far = self.numerators(x)
        if far.dtype == object or (len(far) and float(np.abs(far).max()) ** 2 * far.shape[1] >= 2**62):
            far = [sum(int(v) ** 2 for v in row) for row in far]
            return [v if v < 2**63 else None for v in far]
        return (far * far).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values)[:, None]).T


def distinct(df: DataFrame, vector: str) -> DataFrame:
    """Written (x, copies, weight 1) of the distinct vectors of the prevailing length."""
    grouped = df.select(whole_numbers(F.col(vector)).alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    grouped = written(grouped.withColumn("one", F.lit(1).cast("long")))
    widths = grouped.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("rows"))
    width = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    return grouped.filter(F.size("x") == (width["width"] if width else 0)).filter(F.size("x") > 0)


def fit(vectors: DataFrame, components: int, weights: str = "counts") -> Whitening:
    """Sums, covariance and leading components of distinct vectors, fitted with their counts or with one each."""
    weight = {"counts": "copies", "one": "one"}[weights]
    n, total, largest = sums(vectors, "x", weight)
    model = Whitening(n, total, largest, np.zeros((0, len(total))), np.zeros(0), 0.0)
    if not n:
        return model
    v = covariance(vectors, "x", weight, n, model.centred)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > len(v) * np.finfo(float).eps * max(values.max(), 0.0)][:components]
    axes = axes.T[order]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]) if len(axes) else np.ones(0)
    model.axes, model.values, model.trace = axes * signs[:, None], values[order], float(np.trace(v))
    return model


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Written (x, copies, one, deviation, whitened) of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch, "x")
                lists = pa.FixedSizeListArray.from_arrays(pa.array(model.whitened(x).ravel()), len(model.axes)).cast(pa.list_(pa.float64()))
                arrays = [*(batch[c] for c in ("x", "copies", "one")), pa.array(model.deviations(x), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["x", "copies", "one", "deviation", "whitened"])

    return written(arrow(vectors.select("x", "copies", "one"), run, "x array<long>, copies long, one long, deviation long, whitened array<double>"))


def identity_error(done: DataFrame, weights: str = "counts") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    weight = {"counts": "copies", "one": "one"}[weights]
    n, total, _ = sums(done, "whitened", weight)
    mean = total / n
    found = covariance(done, "whitened", weight, n, lambda w: w - mean)
    return float(np.abs(found - np.eye(len(found))).max())


def join_back(df: DataFrame, key: str, vector: str, done: DataFrame, rows: int) -> DataFrame:
    """(key, deviation, whitened) of every row: frequent vectors by broadcast, the rest by a shuffle."""
    named = lambda d: d.withColumn("h", F.xxhash64("x"))
    own = named(df.select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("x")).filter("x IS NOT NULL"))
    frequent = F.col("copies") * HOT > rows
    want = ["h", "x", "deviation", "whitened"]
    hot, cold = named(done.filter(frequent)), named(done.filter(~frequent))
    quick = own.join(F.broadcast(hot.select(*want)), ["h", "x"])
    slow = own.join(F.broadcast(hot.select("h", "x")), ["h", "x"], "left_anti").join(cold.select(*want), ["h", "x"])
    return quick.unionByName(slow).select("key", "deviation", "whitened")


def whiten(df: DataFrame, key: str, vector: str, components: int = 32, weights: str = "counts") -> tuple[DataFrame, Whitening, float | None]:
    """(key, deviation, whitened) of every row that is not left out, the fitted model, and the identity error (None without components)."""
    vectors = distinct(df, vector)
    model = fit(vectors, components, weights)
    if not len(model.axes):
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"key {kind}, deviation long, whitened array<double>"), model, None
    done = apply(vectors, model)
    rows = model.n if weights == "counts" else done.agg(F.sum("copies")).first()[0]
    return join_back(df, key, vector, done, rows), model, identity_error(done, weights)


def long_form(done: DataFrame, model: Whitening, error: float | None) -> DataFrame:
    """One row for each row and component, numbered from 1, with the share of variance and the figures of the fit."""
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    rows = done.select("key", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        "key",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, "i").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
