"""Support vector machines on random Fourier features (Rahimi and Recht 2007), all classes in the same passes.

A linear machine on such features approximates a radial-basis kernel machine without the kernel matrix. Only the few prepared
features of a row are kept, packed into blocks of rows. Each pass makes the Fourier features anew, ``CHUNK`` rows at a time,
and sums hinge loss and gradient of every class's machine that is still being fitted, so that neither the Fourier features nor
one copy of the rows for each class is stored, and the number of passes does not grow with the classes. A pass returns a few
numbers for each partition, whatever the number of rows.

The machines are those of ``LinearSVC`` (and, for more than two classes, ``OneVsRest``): mean weighted hinge loss and ridge
penalty over centred features divided by their deviation, a free intercept, and the steps of orthant-wise L-BFGS (Andrew and Gao 2007).
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.runtime import fixed

CHUNK = 128
"""Rows whose Fourier features are held at once in a task."""

SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(10)]
"""Series of sin(2 pi u), to the last digit for u in [-1/4, 1/4]."""

MEMORY = 10
"""Steps that L-BFGS looks back."""


@dataclass(frozen=True)
class FourierMap:
    """``dims`` random cosines of ``size`` features, fixed by the seed; ``turns`` and ``shift`` are in full turns."""

    turns: np.ndarray
    shift: np.ndarray

    @classmethod
    def drawn(cls, size: int, dims: int, gamma: float | None, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        g = 1.0 / size if gamma is None else gamma
        weights = rng.normal(scale=np.sqrt(2 * g), size=(size, dims))
        return cls(weights / (2 * math.pi), rng.uniform(0, 2 * np.pi, size=dims) / (2 * math.pi))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """sqrt(2 / dims) cos(x weights + shift); several times faster than numpy's cosine of doubles."""
        z = x @ self.turns
        z += self.shift
        near = np.rint(z)
        z -= near
        np.abs(z, out=z)
        np.subtract(0.25, z, out=z)  # cos(2 pi z) = sin(2 pi (1/4 - |z|))
        square, out = np.multiply(z, z, out=near), np.full_like(z, SINE[-1])
        for c in SINE[-2::-1]:
            out *= square
            out += c
        z *= np.sqrt(2.0 / len(self.shift))
        out *= z
        return out


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, weights, features) of up to ``CHUNK`` rows of the blocks."""
    for batch in batches:
        for block in batch["block"]:
            rows = np.frombuffer(block.as_buffer()).reshape(-1, width)
            for at in range(0, len(rows), CHUNK):
                part = rows[at : at + CHUNK]
                yield part[:, 0], part[:, 1], part[:, 2:]


def packed(train: DataFrame, size: int) -> DataFrame:
    """Rows of (label, weight, features) as blocks of doubles, one for each Arrow batch, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                rows = np.column_stack([batch["label"].to_numpy(zero_copy_only=False), batch["weight"].to_numpy(zero_copy_only=False), x])
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["block"])

    rows = train.select(F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), vector_to_array("features").alias("x"))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fixed(rows.mapInArrow(run, "block binary").repartition(tasks))


def summed(blocks: DataFrame, width: int, add, size: int) -> np.ndarray:
    """Sum of ``add(total, labels, weights, features)`` over all rows, partition after partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for y, w, x in chunks(batches, width):
            add(total, y, w, x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = blocks.mapInArrow(run, "total binary").withColumn("part", F.spark_partition_id()).collect()
    return np.sum([np.frombuffer(r["total"]) for r in sorted(parts, key=lambda r: r["part"])] or [np.zeros(size)], axis=0)


def spread(blocks: DataFrame, width: int, fourier: FourierMap) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the weights, and the weighted mean and sample deviation of every Fourier feature."""
    dims = len(fourier.shift)
    first = blocks.first()
    origin = fourier(np.frombuffer(first["block"]).reshape(-1, width)[:1, 2:])[0]

    def add(total: np.ndarray, y: np.ndarray, w: np.ndarray, x: np.ndarray) -> None:
        gap = fourier(x) - origin
        total[:2] += w.sum(), w @ w
        total[2 : 2 + dims] += w @ gap
        gap *= gap
        total[2 + dims :] += w @ gap

    total = summed(blocks, width, add, 2 + 2 * dims)
    weight, squares, one, two = total[0], total[1], total[2 : 2 + dims], total[2 + dims :]
    free = weight - squares / weight
    deviation = np.sqrt(np.maximum(two - one * one / weight, 0.0) / free) if free > 0 else np.zeros(dims)
    return weight, origin + one / weight, np.where(deviation > 1e-12, deviation, 0.0)  # below: rounding of equal values


def _downhill(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """L-BFGS direction from the (step, change of gradient) pairs, latest first, without the parts that lead uphill."""
    out, parts = grad.copy(), []
    for s, d in steps:
        rho = s @ d
        a = (s @ out) / rho
        parts.append((a, rho))
        out -= a * d
    if steps:
        s, d = steps[0]
        out *= (s @ d) / (d @ d)
    for (s, d), (a, rho) in zip(reversed(steps), reversed(parts)):
        out += (a - (d @ out) / rho) * s
    return np.where(out * grad > 0, -out, 0.0)


def minimised(start: np.ndarray, most: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Orthant-wise L-BFGS: yields a point, is sent its value and gradient, and returns the point where it ends.

    A step starts at half the length and halves or grows until the strong Wolfe conditions hold. It ends after ``most`` steps, at a gradient or a change over 20 values
    within the tolerance, or where a step fails again just after the memory was cleared.
    """
    x, steps, recent, failed, done = start, [], [math.inf], False, 0
    value, grad = yield x
    at_start = value
    while True:
        still = len(recent) > 1 and abs(value - max(recent)) <= tolerance * at_start
        if done >= most or still or np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            return x
        side = np.where(x != 0, np.sign(x), np.sign(-grad))
        curved = not steps or steps[0][0] @ steps[0][1] >= 0
        found = None
        if curved:
            with np.errstate(divide="ignore", invalid="ignore"):
                along = _downhill(grad, steps)
            slope, rate = along @ grad, 0.5 if done else 0.05 / np.linalg.norm(grad)
            for _ in range(20 if np.isfinite(along).all() else 0):
                new = x + rate * along
                new = np.where(np.sign(new) == side, new, 0.0)
                v, g = yield new
                if v > value + rate * slope * 1e-4 or (g @ along >= 0.9 * slope and g @ along > -0.9 * slope):
                    times = 0.5 if done else 0.1
                elif g @ along < 0.9 * slope:
                    times = 2.1
                else:
                    found = new, v, g
                    break
                rate *= times
                if not 1e-10 <= rate <= 1e10:
                    break
        if found is None:
            if failed:
                return x
            failed, steps = True, []
            continue
        new, v, g = found
        steps = [(new - x, g - grad), *steps][:MEMORY]
        x, value, grad, failed, done = new, v, g, False, done + 1
        recent = [*recent, value][-20:]


@dataclass(frozen=True)
class FourierModel:
    """Margins of the machines on ``features``: the class of the largest one, or the sign of the only one."""

    fourier: FourierMap
    coefficients: np.ndarray
    intercepts: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        fourier, coefficients, intercepts = self.fourier, self.coefficients, self.intercepts

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            rows, out = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, len(fourier.turns))), np.zeros(len(x))
            for at in range(0, len(rows), CHUNK):
                margin = fourier(rows[at : at + CHUNK]) @ coefficients + intercepts
                out[at : at + CHUNK] = margin.argmax(axis=1) if len(intercepts) > 1 else margin[:, 0] > 0
            return pd.Series(out)

        return df.withColumn("prediction", predict(vector_to_array("features")))


@dataclass(frozen=True)
class FourierMachines:
    """One machine for two classes (0 and 1), else one of each class 0, 1, ... against the rest."""

    seed: int
    classes: int = 2
    iterations: int = 50
    penalty: float = 1e-3
    tolerance: float = 1e-6
    dims: int = 200
    gamma: float | None = None

    def fit(self, train: DataFrame) -> FourierModel:
        """Machines of the rows' ``features``, ``label`` and ``weight``."""
        size = len(train.select(vector_to_array("features").alias("f")).first()["f"])
        fourier, width, dims = FourierMap.drawn(size, self.dims, self.gamma, self.seed), size + 2, self.dims
        blocks = packed(train, size)
        weight, mean, deviation = spread(blocks, width, fourier)
        scale = np.divide(1.0, deviation, out=np.zeros(dims), where=deviation != 0)
        classes = [1] if self.classes <= 2 else list(range(int(train.agg(F.max("label")).first()[0]) + 1))

        def losses(points: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Sums of loss and gradient, one row for each machine."""
            slopes, k = (points[:, :-1] * scale).T, len(of)
            free = points[:, -1] - mean @ slopes

            def add(total: np.ndarray, y: np.ndarray, w: np.ndarray, x: np.ndarray) -> None:
                z, own = fourier(x), total.reshape(k, dims + 2)
                sign = np.where(y[:, None] == of, 1.0, -1.0)
                short = 1.0 - sign * (z @ slopes + free)
                push = np.where(short > 0, -sign * w[:, None], 0.0)
                own[:, 0] += w @ np.maximum(short, 0.0)
                own[:, 1:-1] += push.T @ z
                own[:, -1] += push.sum(axis=0)

            return summed(blocks, width, add, k * (dims + 2)).reshape(k, -1) / weight

        runs = {c: minimised(np.zeros(dims + 1), self.iterations, self.tolerance) for c in classes}
        asked, ended = {c: next(run) for c, run in runs.items()}, {}
        while asked:
            points = np.array([*asked.values()])
            for c, x, found in zip(list(asked), points, losses(points, np.array([*asked], float))):
                value = found[0] + 0.5 * self.penalty * (x[:-1] @ x[:-1])
                grad = np.append((found[1:-1] - found[-1] * mean) * scale + self.penalty * x[:-1], found[-1])
                try:
                    asked[c] = runs[c].send((value, grad))
                except StopIteration as end:
                    ended[c] = end.value
                    del asked[c]
        final = np.array([ended[c] for c in classes])
        slopes = (final[:, :-1] * scale).T
        return FourierModel(fourier, slopes, final[:, -1] - mean @ slopes)
