"""Exact nearest neighbours by cells, and synthetic rows of a minority class between them.

1. Equal points are one point with the least ``k + 1`` keys of its rows, so copies never meet each other.
2. A balanced tree of median cuts is fitted on a bounded hash sample of the points. It cuts space into cells of about
   ``CELL_ROWS`` points, at most ``MOST_CELLS``; which points were drawn changes the cost, never the result.
3. Each point is compared with its own cell. The distance of its farthest neighbour there is a radius, and the point visits
   just the other cells that its ball touches, found down the tree. Spark moves points to cells; numpy compares within one, by
   leaves of ``LEAF_ROWS`` points of which each ball meets few: a cell's work grows little faster than its points.
4. The nearest of all visited cells are ranked by distance, then key.

A cell that many balls touch is met by slices of them. In many dimensions balls touch more cells: the result stays exact, the
work grows. Rows with a missing feature (null or NaN) have no neighbours and are none; a missing key counts as no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.scalars import without_nan
from statloom.operators.sampling import marked
from statloom.runtime import fixed, lookup

CELL_ROWS = 2_000
MOST_CELLS = 4_096

SAMPLE_PER_CELL = 40
"""Points drawn for each cell to find the cuts: at most 163,840 in all."""

LEAF_ROWS = 64
"""Points of a leaf, within a task, that are compared at once."""

VISITORS = 20_000
"""Points that meet a cell at once."""

BLOCK = 4_000_000
"""Distances held at once in a task."""


class Cells:
    """Median cuts: inner node ``i`` has the children ``2 i + 1`` (up to the cut) and ``2 i + 2``; each leaf is a closed box."""

    def __init__(self, sample: np.ndarray, depth: int):
        dims, inner = sample.shape[1], 2**depth - 1
        self.depth, self.axis, self.cut = depth, np.zeros(inner, int), np.zeros(inner)
        low, high = np.full((2 * inner + 1, dims), -np.inf), np.full((2 * inner + 1, dims), np.inf)
        held = {0: sample}
        for node in range(inner):
            mine = held.pop(node)
            axis = int(np.argmax(np.ptp(mine, axis=0))) if len(mine) else 0
            cut = float(np.median(mine[:, axis])) if len(mine) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            left = mine[:, axis] <= cut
            for child, rows in ((2 * node + 1, mine[left]), (2 * node + 2, mine[~left])):
                held[child], low[child], high[child] = rows, low[node], high[node]
            high[2 * node + 1, axis] = min(high[node, axis], cut)
            low[2 * node + 2, axis] = max(low[node, axis], cut)
        self.low, self.high = low[inner:], high[inner:]
        self._low, self._high = low, high

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - len(self.cut)

    def reached(self, x: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a cell within its squared radius, found down the tree, in blocks of points."""
        points, cells, step = [], [], max(1, BLOCK // len(self.low))
        for at in range(0, len(x), step):
            row = np.arange(at, min(at + step, len(x)))
            node = np.zeros(len(row), int)
            for _ in range(self.depth):
                row, node = np.repeat(row, 2), np.column_stack([2 * node + 1, 2 * node + 2]).ravel()
                far = 0.0
                for d in range(x.shape[1]):
                    v = x[row, d]
                    gap = np.maximum(np.maximum(self._low[node, d] - v, v - self._high[node, d]), 0.0)
                    far = far + gap * gap
                near = far <= squared[row]
                row, node = row[near], node[near]
            points.append(row)
            cells.append(node - len(self.cut))
        return np.concatenate(points or [np.zeros(0, int)]), np.concatenate(cells or [np.zeros(0, int)])

    def touched(self, x: np.ndarray, squared: np.ndarray) -> list[np.ndarray]:
        """The cells, other than its own, within each point's squared radius."""
        row, cell = self.reached(x, squared)
        other = cell != self.home(x)[row]
        row, cell = row[other], cell[other]
        return np.split(cell, np.searchsorted(row, np.arange(1, len(x)))) if len(x) else []


def distances(queries: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, squared distances to all points) by blocks of queries."""
    step = max(1, BLOCK // max(len(points), 1))
    for at in range(0, len(queries), step):
        part, far = queries[at : at + step], 0.0
        for d in range(queries.shape[1]):
            gap = part[:, d, None] - points[:, d]
            far = far + gap * gap
        yield at, far


def closest(queries: np.ndarray, points: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, squared distance, place) of the k nearest points of each query, among equals the first point.

    The points are cut again into leaves of about ``LEAF_ROWS``. A query's own leaf gives a radius, unless ``within`` states one,
    and only the leaves in its reach are compared; points beyond a stated radius are left out.
    """
    if not (np.isfinite(queries).all() and np.isfinite(points).all()):
        found = [(at + np.repeat(np.arange(len(far)), min(k, len(points))), far, np.argsort(far, axis=1, kind="stable")[:, :k]) for at, far in distances(queries, points)]
        return tuple(np.concatenate(c) for c in zip(*[(q, np.take_along_axis(far, o, axis=1).ravel(), o.ravel()) for q, far, o in found]))
    leaves = Cells(points, max(0, int(np.ceil(np.log2(len(points) / LEAF_ROWS)))))
    leaf = leaves.home(points)
    order = np.argsort(leaf, kind="stable")
    bounds = np.searchsorted(leaf[order], np.arange(len(leaves.low) + 1))
    held = [order[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]

    def groups(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``cell``, points) of each leaf that is named there."""
        along = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[along], np.arange(len(held) + 1))
        return ((along[lo:hi], mine) for mine, lo, hi in zip(held, cuts[:-1], cuts[1:]) if hi > lo)

    radius = np.full(len(queries), np.inf) if within is None else within
    if within is None:
        for mine, near in groups(leaves.home(queries)):
            if len(near) >= k:
                for at, far in distances(queries[mine], points[near]):
                    radius[mine[at : at + len(far)]] = np.partition(far, k - 1, axis=1)[:, k - 1]
    row, cell = leaves.reached(queries, radius)
    parts = [(np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
    for pairs, near in groups(cell):
        mine = row[pairs]
        for at, far in distances(queries[mine], points[near]):
            q = mine[at : at + len(far)]
            i, j = np.nonzero(far <= radius[q, None])
            parts.append((q[i], far[i, j], near[j]))
    query, far, place = (np.concatenate(c) for c in zip(*parts))
    ranked = np.lexsort((place, far, query))
    query, far, place = query[ranked], far[ranked], place[ranked]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], far[best], place[best]


def _matrix(columns: Sequence) -> np.ndarray:
    """Feature columns side by side, as rows of a matrix."""
    return np.column_stack([np.asarray(c, float) for c in columns])


def _compare(k: int, features: Sequence[str], keep: Sequence[str]):
    """Visitors of a cell (``features``, within if they state a radius) against its points (``features``, keys).

    Returns the ``keep`` columns of each visitor that has neighbours there and ``best``, the list of them.
    """

    def run(visitors: pa.Table, held: pa.Table) -> pa.Table:
        keys = pa.concat_arrays(held["keys"].chunks) if held.num_rows else pa.array([], held.schema.field("keys").type)
        near, parent = keys.flatten(), pc.list_parent_indices(keys).to_numpy()
        order = pc.sort_indices(near).to_numpy()
        near, at = near.take(pa.array(order)), parent[order]
        points = _matrix([held[c] for c in features])[at]
        query, far, place = np.zeros(0, int), np.zeros(0), np.zeros(0, int)
        if visitors.num_rows and len(points):
            within = visitors["within"].to_numpy() if "within" in visitors.column_names else None
            query, far, place = closest(_matrix([visitors[c] for c in features]), points, k, within)
        met, first = np.unique(query, return_index=True)
        ends = pa.array(np.arange(len(query) + 1) * len(features), pa.int32())
        near_x = pa.ListArray.from_arrays(ends, pa.array(points[place].ravel()))
        entries = pa.StructArray.from_arrays([pa.array(far), near.take(pa.array(place)), near_x], ["far", "near", "near_x"])
        best = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), entries)
        return visitors.select(list(keep)).take(pa.array(met)).append_column("best", best)

    return run


def nearest(df: DataFrame, key: str, features: Sequence[str], k: int = 5, cell_rows: int | None = None) -> DataFrame:
    """(key, x, neighbours): of each row with all features, the ``k`` nearest other rows by Euclidean distance, then key.

    ``key`` identifies a row; ``x`` is the array of its features and ``neighbours`` an array of (far: squared distance, near: key,
    near_x: array), nearest first, with fewer than ``k`` entries where there are fewer other rows.
    """
    entry = T.StructType().add("far", "double").add("near", df.schema[key].dataType).add("near_x", T.ArrayType(T.DoubleType()))
    shape = T.StructField("best", T.ArrayType(entry))
    xs = [f"_x{i}" for i in range(len(features))]
    whole = without_nan(df.select(key, *features), features).dropna(subset=[key, *features])
    rows = fixed(whole.select(F.col(key).alias("_key"), *[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip(features, xs)]))
    place = F.row_number().over(Window.partitionBy(*xs).orderBy("_key"))
    points = rows.withColumn("_place", place).where(F.col("_place") <= k + 1)
    points = points.groupBy(*xs).agg(F.sort_array(F.collect_list("_key")).alias("keys"))
    points = fixed(points.withColumn("home", F.col("keys")[0]))

    n = points.count()
    depth = min(max(0, int(np.ceil(np.log2(max(n, 1) / (cell_rows or CELL_ROWS))))), int(np.log2(MOST_CELLS)))
    wanted = SAMPLE_PER_CELL * 2**depth
    drawn = points.where(F.pmod(F.xxhash64("home"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(n, 1))) + 1)
    drawn = drawn.select(*xs).limit(2 * wanted).toPandas().to_numpy(float) if depth else np.zeros((0, len(xs)))
    cells = Cells(drawn, depth)

    @F.pandas_udf("int")
    def home_cell(*x: pd.Series) -> pd.Series:
        return pd.Series(cells.home(_matrix(x)))

    @F.pandas_udf("array<int>")
    def other_cells(far: pd.Series, *x: pd.Series) -> pd.Series:
        return pd.Series(cells.touched(_matrix(x), far.to_numpy()))

    points = fixed(points.withColumn("cell", home_cell(*xs)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(visitors: DataFrame, *keep: str) -> DataFrame:
        most = visitors.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        slices = 1 + most // VISITORS
        held = points.select("cell", "keys", *xs, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        cut = visitors.withColumn("slice", F.pmod(F.xxhash64("home"), F.lit(slices)).cast("int"))
        # Few bytes, much work: a stated number of partitions is not coalesced.
        sides = [side.repartition(tasks, "cell", "slice").groupBy("cell", "slice") for side in (cut, held)]
        made = T.StructType([*[visitors.schema[c] for c in keep], shape])
        return sides[0].cogroup(sides[1]).applyInArrow(_compare(k + 1, xs, keep), made)

    # What the cells found is met by several later steps: fixed, so that no comparison is made twice.
    own = fixed(meet(points, "home", "keys", *xs))
    found = own.select("home", "best")
    if depth:
        radius = F.when(F.size("best") > k, F.col("best")[k]["far"]).otherwise(F.lit(float("inf")))
        reach = own.select("home", *xs, radius.alias("within"))
        visits = fixed(reach.withColumn("cell", F.explode(other_cells("within", *xs))))
        found = found.unionByName(meet(visits, "home"))
    best = found.groupBy("home").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k + 1).alias("all"))
    best = fixed(own.select("home", "keys", *xs).join(best, "home").drop("home"))
    others = F.slice(F.filter("all", lambda e: e["near"] != F.col("_key")), 1, k)
    # The keys of a point are all its rows unless there are k + 1 of them.
    few = best.where(F.size("keys") <= k).withColumn("_key", F.explode("keys")).drop("keys")
    many = lookup(rows, best.where(F.size("keys") > k).drop("keys"), xs, spread=["_key"])
    return few.unionByName(many).select(F.col("_key").alias(key), F.array(*xs).alias("x"), others.alias("neighbours"))


def _digits(digest: str, start: int) -> Column:
    """Eight digits of a hexadecimal hash as a whole number."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def synthetic_minority(
    df: DataFrame, key: str, features: Sequence[str], minority: Column, k: int = 5, seed: int = 42, need: int | None = None, **kw
) -> DataFrame:
    """(key, copy, neighbour, gap, features): new rows between minority rows and their neighbours of the same class.

    ``need`` rows are made, by default as many as the class lacks to the rest; each minority row gives the same number and the
    first ones in hash order one more. A hash of (key, seed, copy) draws one of the row's ``k`` nearest and the place
    ``gap`` in [0, 1) on the line to it. Distances use features divided by their population deviation over ``df`` (a constant
    one as it is). Rows with a missing feature or key neither count nor give any, and a class of a single row gives none.
    """
    features = list(features)
    rows = without_nan(df.select(key, *features, F.coalesce(minority, F.lit(False)).alias("_minor")), features)
    rows = fixed(rows.dropna(subset=[key, *features]).withColumns({c: F.col(c).cast("double") for c in features}))
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_minor").alias("minor"), *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(features)]
    ).first()
    few = sums["minor"]
    need = max(0, sums["n"] - 2 * few) if need is None else need
    scale = [sums[f"s_{i}"] or 1.0 for i in range(len(features))]
    scaled = rows.where("_minor").select(key, *[(F.col(c) / s).alias(c) for c, s in zip(features, scale)])
    near = nearest(scaled, key, features, k, **kw)

    each, extra = divmod(need, max(few, 1))
    near = marked(near.where(F.size("neighbours") > 0), key, lambda n: F.least(n, F.lit(extra)), None, seed)
    times = F.lit(each) + F.col("_taken").cast("int")
    made = near.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    made = made.withColumn("_draw", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.col("copy").cast("string"))))
    made = made.withColumns({"_to": F.get("neighbours", F.pmod(_digits("_draw", 1), F.size("neighbours")).cast("int")), "gap": _digits("_draw", 9) / float(2**32)})
    at = [((F.col("x")[i] + F.col("gap") * (F.col("_to.near_x")[i] - F.col("x")[i])) * s).alias(c) for i, (c, s) in enumerate(zip(features, scale))]
    return made.select(key, "copy", F.col("_to.near").alias("neighbour"), "gap", *at)
