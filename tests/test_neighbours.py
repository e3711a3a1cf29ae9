"""Nearest neighbours against brute force, and the synthetic rows made of them."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.learning import neighbours

COLUMNS = ["a", "b", "c"]


def brute(pdf, k):
    pdf = pdf.dropna()
    x, keys = pdf[COLUMNS].to_numpy(), pdf["id"].to_numpy()
    out = {}
    for i, key in enumerate(keys):
        far = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((keys, far)) if j != i][:k]
        out[key] = keys[order].tolist()
    return out


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    loose = rng.normal(size=(1200, 3)) * [1, 5, 0.2]
    dense = rng.integers(0, 3, size=(300, 3)).astype(float)  # ties and copies
    hot = np.full((700, 3), 0.5)  # a third of all rows
    pdf = pd.DataFrame(np.vstack([loose, dense, hot, [[np.nan, 0, 0]]]), columns=COLUMNS)
    pdf["id"] = rng.permutation(len(pdf))
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("cell_rows, visitors", [(None, 20_000), (40, 20_000), (40, 60)])
def test_same_as_brute_force(points, monkeypatch, cell_rows, visitors):
    monkeypatch.setattr(neighbours, "VISITORS", visitors)
    pdf, df = points
    got = {r["id"]: [e["near"] for e in r["neighbours"]] for r in neighbours.nearest(df, "id", COLUMNS, 4, cell_rows).collect()}
    assert got == brute(pdf, 4)


def test_cells_cover_space():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    cells = neighbours.Cells(x[:400], 5)
    own = cells.home(x)
    assert ((cells.low[own] <= x) & (x <= cells.high[own])).all() and np.bincount(own, minlength=32).max() < 400
    for i, touched in enumerate(cells.touched(x[:50], np.full(50, 0.04))):
        near = np.unique(own[((x - x[i]) ** 2).sum(axis=1) <= 0.04])
        assert set(near) <= {own[i], *touched}


def test_synthetic_rows(spark, points):
    pdf, df = points
    marked = df.withColumn("minor", F.col("id") % 5 == 0)
    got = neighbours.synthetic_minority(marked, "id", COLUMNS, F.col("minor"), 3).toPandas()
    whole = pdf.dropna()
    minor = whole[whole["id"] % 5 == 0]
    assert len(got) == len(whole) - 2 * len(minor)
    times = got.groupby("id").size()
    assert set(times.index) == set(minor["id"]) and times.max() - times.min() <= 1
    assert got["gap"].between(0, 1, inclusive="left").all() and got["gap"].mean() == pytest.approx(0.5, abs=0.05)
    scaled = minor.assign(**{c: minor[c] / whole[c].std(ddof=0) for c in COLUMNS})
    near, at = brute(scaled, 3), whole.set_index("id")[COLUMNS]
    assert all(b in near[a] for a, b in zip(got["id"], got["neighbour"]))
    a, b = at.loc[got["id"]].to_numpy(), at.loc[got["neighbour"]].to_numpy()
    assert np.allclose(got[COLUMNS].to_numpy(), a + got["gap"].to_numpy()[:, None] * (b - a))
    again = neighbours.synthetic_minority(marked.repartition(3), "id", COLUMNS, F.col("minor"), 3).toPandas()
    got, again = (t.sort_values(["id", "copy"], ignore_index=True) for t in (got, again))
    drawn = ["id", "copy", "neighbour", "gap"]
    assert got[drawn].equals(again[drawn]) and np.allclose(got[COLUMNS], again[COLUMNS], rtol=1e-12)


def test_edges(spark):
    schema = "id string, a double, b double, extra int"
    one = spark.createDataFrame([("x", 1.0, 1.0, 1), ("y", 1.0, None, 2), (None, 1.0, 2.0, 3), ("z", 1.0, 5.0, 4)], schema)
    got = {r["id"]: [e["near"] for e in r["neighbours"]] for r in neighbours.nearest(one, "id", ["a", "b"], 2).collect()}
    assert got == {"x": ["z"], "z": ["x"]}
    assert neighbours.nearest(one.limit(0), "id", ["a", "b"]).count() == 0
    assert neighbours.synthetic_minority(one.limit(0), "id", ["a", "b"], F.col("extra") == 1).count() == 0
    assert neighbours.synthetic_minority(one, "id", ["a", "b"], F.col("id") == "x", need=3).count() == 0
    made = neighbours.synthetic_minority(one, "id", ["a", "b"], F.col("extra") > 0, need=3)
    assert made.count() == 3 and {r["id"] for r in made.collect()} == {"x", "z"}


def test_cells_are_compared_once(spark, points, monkeypatch):
    compared, whole = spark.sparkContext.accumulator(0), neighbours._compare

    def counted(*args):
        run = whole(*args)

        def count(visitors, held):
            compared.add(len(visitors))
            return run(visitors, held)

        return count

    monkeypatch.setattr(neighbours, "_compare", counted)
    monkeypatch.setattr(neighbours, "lookup", partial(neighbours.lookup, max_rows=10))  # as many points: no table is held on the driver
    marked = points[1].withColumn("minor", F.col("id") % 3 == 0)
    made = neighbours.synthetic_minority(marked, "id", COLUMNS, F.col("minor"), 3, need=500, cell_rows=40)
    first = compared.value
    assert made.count() == len(made.collect()) == 500
    assert first > 0 and compared.value == first


def test_crowded_points_name_all_their_rows(spark):
    """Points of fewer, just as many and more rows than a point lists, with text keys."""
    pdf = pd.DataFrame({"id": [f"k{i:02d}" for i in range(23)], "a": np.repeat([0.0, 1.0, 3.0, 7.0, 8.0], [1, 4, 5, 6, 7]), "b": 0.0, "c": -0.0})
    got = {r["id"]: [e["near"] for e in r["neighbours"]] for r in neighbours.nearest(spark.createDataFrame(pdf), "id", COLUMNS, 4).collect()}
    assert got == brute(pdf, 4)


@pytest.mark.parametrize("kind", ["loose", "grid", "copies", "infinite"])
def test_closest_compares_few_points(monkeypatch, kind):
    rng = np.random.default_rng(3)
    points = {"loose": rng.normal(size=(6000, 3)), "grid": rng.integers(0, 12, size=(6000, 3)) / 7, "copies": np.repeat(rng.normal(size=(1000, 3)), 6, axis=0)}
    points = points.get(kind, np.vstack([rng.normal(size=(5999, 3)), [[np.inf, 0, 0]]]))
    queries, compared, whole = points[:500], [], neighbours.distances

    def counted(*args):
        for at, far in whole(*args):
            compared.append(far.size)
            yield at, far

    monkeypatch.setattr(neighbours, "distances", counted)
    query, far, place = neighbours.closest(queries, points, 6)
    with np.errstate(invalid="ignore"):
        gaps = queries[:, None, :] - points
    all_far = (gaps[:, :, 0] * gaps[:, :, 0] + gaps[:, :, 1] * gaps[:, :, 1]) + gaps[:, :, 2] * gaps[:, :, 2]
    want = np.argsort(all_far, axis=1, kind="stable")[:, :6]
    assert (place.reshape(-1, 6) == want).all() and (query == np.repeat(np.arange(500), 6)).all()
    assert (far == np.take_along_axis(all_far, want, axis=1).ravel()).all()
    assert kind == "infinite" or sum(compared) < 0.3 * all_far.size
    limit = np.sort(all_far, axis=1)[:, 2]
    if kind != "infinite":
        query, far, place = neighbours.closest(queries, points, 6, limit)
        kept = [[j for j in row if all_far[i, j] <= limit[i]] for i, row in enumerate(want)]
        assert place.tolist() == [j for row in kept for j in row] and (far <= limit[query]).all()
