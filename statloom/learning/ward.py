"""Ward's hierarchy over clustering features.

One pass over the rows adds up micro-clusters (rows, sum vector, sum of squares), one for each cell of a fixed partition of
space; features of this kind merge by addition, so a crowded cell is summed where its rows are. The cells are the sign patterns of
``bits`` Walsh directions about the mean, each of which uses every dimension: there are at most 2 ** ``bits``, whatever the number of rows, and
these few are merged by Ward's criterion on the driver. Rows get their cluster by their cell.

Rows with a missing feature are left out. If every cell holds one row, the result is the hierarchy of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.runtime import fixed

BITS = 10


def directions(size: int, bits: int) -> np.ndarray:
    """The first ``bits`` Walsh functions after the constant one: +1 or -1 for each dimension."""
    j = np.arange(size)
    return np.array([[1 - 2 * (bin(b & int(i)).count("1") % 2) for i in j] for b in range(1, bits + 1)], float).reshape(bits, size)


def cell(vector: Column, mean: Sequence[float], bits: int = BITS) -> Column:
    """The cell of a row: bit b is set where the row lies on the positive side of direction b; null where an entry is missing."""
    way, centre, weight = directions(len(mean), bits), np.asarray(mean, float), 2 ** np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.vstack([np.asarray(v, float) for v in batch]) if len(batch) else np.zeros((0, len(centre)))
            found = pd.Series(((x - centre) @ way.T > 0).astype(np.int64) @ weight, dtype="Int64")
            yield found.mask(np.isnan(x).any(axis=1))

    return F.pandas_udf(run, "long")(vector)


def micro_clusters(df: DataFrame, cols: Sequence[str], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The complete rows with their ``cell``, checkpointed since both the sums and the assignment read them, and (cell, n, ss, s1 ..): the features of each cell that has rows."""
    features = F.array(*[F.col(c).cast("double") for c in cols])
    part = [F.get("_v", F.lit(i)) for i in range(len(cols))]
    whole = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v))
    means = df.select(features.alias("_v")).agg(*[F.avg(F.when(whole, p)).alias(c) for p, c in zip(part, cols)]).first()
    # The function, not a filter, drops incomplete rows: the optimiser multiplies filters on many aliased columns.
    rows = fixed(df.withColumn("_v", features).withColumn("cell", cell(F.col("_v"), [m or 0.0 for m in means], bits)))
    rows = rows.where(F.col("cell").isNotNull())
    norm = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v)
    sums = [F.sum(p).alias(f"s{i + 1}") for i, p in enumerate(part)]
    table = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("ss"), *sums)
    return rows.drop("_v"), table


@dataclass
class Hierarchy:
    """Cells in order, and the merges: (left, right, rise of the squared error), ends being places of earlier clusters."""

    cells: list[int]
    merges: list[tuple[int, int, float]]

    def cut(self, k: int) -> dict[int, int]:
        """Cell to cluster number when ``k`` clusters are left; clusters are numbered by their first cell."""
        held = {i: [c] for i, c in enumerate(self.cells)}
        for at, (a, b, _) in enumerate(self.merges[: max(len(self.cells) - k, 0)]):
            held[len(self.cells) + at] = held.pop(a) + held.pop(b)
        return {c: i for i, group in enumerate(sorted(held.values(), key=min)) for c in group}


def hierarchy(cells: Sequence[int], n: np.ndarray, sums: np.ndarray) -> Hierarchy:
    """Merge the pair with the least rise of the squared error until one cluster is left; of equal pairs the first."""
    size = len(cells)
    n, centre = np.concatenate([n.astype(float), np.zeros(max(size - 1, 0))]), np.zeros((max(2 * size - 1, 0), sums.shape[1]))
    centre[:size] = sums / n[:size, None]
    cost = np.full((len(centre),) * 2, np.inf)

    def rises(i: int, others: np.ndarray) -> np.ndarray:
        far = ((centre[others] - centre[i]) ** 2).sum(axis=1)
        return n[i] * n[others] / (n[i] + n[others]) * far

    for i in range(size - 1):
        cost[i, i + 1 : size] = rises(i, np.arange(i + 1, size))
    alive, merges = list(range(size)), []
    for new in range(size, 2 * size - 1):
        a, b = divmod(int(cost.argmin()), len(cost))
        merges.append((a, b, float(cost[a, b])))
        n[new] = n[a] + n[b]
        centre[new] = (n[a] * centre[a] + n[b] * centre[b]) / n[new]
        alive = [i for i in alive if i not in (a, b)]
        for gone in (a, b):
            cost[gone, :] = cost[:, gone] = np.inf
        if alive:
            cost[alive, new] = rises(new, np.array(alive))
        alive.append(new)
    return Hierarchy(list(cells), merges)


def fit(features: DataFrame, size: int) -> Hierarchy:
    """The hierarchy of a table of micro-clusters over ``size`` dimensions."""
    pdf = features.orderBy("cell").toPandas()
    sums = pdf[[f"s{i + 1}" for i in range(size)]].to_numpy(float)
    return hierarchy([int(c) for c in pdf["cell"]], pdf["n"].to_numpy(), sums)


def assign(rows: DataFrame, tree: Hierarchy, k: int, into: str = "cluster") -> DataFrame:
    """Add each row's cluster among ``k``; ``rows`` have their cell."""
    table = rows.sparkSession.createDataFrame(sorted(tree.cut(k).items()), f"cell long, {into} int")
    return rows.join(F.broadcast(table), "cell")
