"""Ward over clustering features, Euclidean silhouettes and the diagonal mixture, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.learning import clusters, ward

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(160, 3)) + np.repeat([[0, 0, 0], [4, 1, 0], [0, 5, 2], [9, 9, 9]], 40, axis=0), columns=COLS)
    pdf["id"], pdf["k"] = np.arange(160), np.repeat(["x", "y", "z", "x"], 40)
    pdf.loc[159, "k"] = "alone"
    rows = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([(None, 1.0, 1.0, 900, "x"), (float("nan"), 1.0, 1.0, 901, "x"), (1.0, 1.0, 1.0, 902, None)], "a double, b double, c double, id long, k string")
    return pdf, rows.unionByName(odd).repartition(4)


def plain_ward(points):
    """Rises of the squared error, merging the cheapest pair each time."""
    groups, rises = [[i] for i in range(len(points))], []
    error = lambda g: ((points[g] - points[g].mean(axis=0)) ** 2).sum()
    while len(groups) > 1:
        best = min(((error(a + b) - error(a) - error(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        rises.append(best[0])
        a, b = groups[best[1]], groups[best[2]]
        groups = [g for g in groups if g is not a and g is not b] + [a + b]
    return rises


def test_ward_of_single_rows_is_ward(data):
    pdf, _ = data
    points = pdf[COLS].to_numpy()[:30]
    tree = ward.hierarchy(list(range(30)), np.ones(30), points)
    np.testing.assert_allclose([m[2] for m in tree.merges], plain_ward(points), rtol=1e-9)
    assert sorted(tree.cut(30)) == list(range(30)) and set(tree.cut(1).values()) == {0}


def test_micro_clusters_and_assignment(data):
    pdf, df = data
    rows, features = ward.micro_clusters(df.where("id < 160"), COLS, bits=3)
    way = ward.directions(3, 3)
    x = pdf[COLS].to_numpy()
    cells = ((x - x.mean(axis=0)) @ way.T > 0) @ (2 ** np.arange(3))
    got = features.toPandas().set_index("cell")
    assert set(got.index) == set(cells)
    for c in set(cells):
        part = x[cells == c]
        assert got.loc[c, "n"] == len(part)
        np.testing.assert_allclose(got.loc[c, ["s1", "s2", "s3"]].astype(float), part.sum(axis=0))
        assert got.loc[c, "ss"] == pytest.approx((part**2).sum())
    tree = ward.fit(features, 3)
    for k in (1, 2, 4, 100):
        done = ward.assign(rows, tree, k).toPandas()
        assert len(done) == 160 and done["cluster"].nunique() == min(k, len(set(cells)))
        assert (done.groupby("cell")["cluster"].nunique() == 1).all()
    all_rows, _ = ward.micro_clusters(df, COLS, bits=3)
    assert {r["id"] for r in all_rows.select("id").collect()} == set(range(160)) | {902}
    empty, none = ward.micro_clusters(df.limit(0), COLS)
    assert empty.count() == 0 and ward.fit(none, 3).merges == []


def plain_silhouettes(pdf, power):
    x, k, out = pdf[COLS].to_numpy(), pdf["k"].to_numpy(), {}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** power
    for i in range(len(x)):
        own = k == k[i]
        if own.sum() == 1:
            out[pdf["id"].iloc[i]] = 0.0
            continue
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, k == c].mean() for c in set(k) if c != k[i])
        out[pdf["id"].iloc[i]] = (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("numbers", [4_000_000, 5])
def test_squared_silhouettes_in_any_number_of_passes(data, monkeypatch, numbers):
    monkeypatch.setattr(clusters, "CLOSURE_NUMBERS", numbers)
    pdf, df = data
    got = {r["id"]: r["silhouette"] for r in clusters.point_silhouettes(df, "id", COLS, "k").collect()}
    assert got == pytest.approx(plain_silhouettes(pdf, 2), abs=1e-9)


def test_euclidean_silhouettes(data):
    pdf, df = data
    want = plain_silhouettes(pdf, 1)
    rows = clusters.euclidean_silhouettes(df, "id", COLS, "k").collect()
    assert {r["id"]: r["silhouette"] for r in rows} == pytest.approx(want, abs=1e-9) and {r["error"] for r in rows} == {0.0}
    sampled = clusters.euclidean_silhouettes(df, "id", COLS, "k", anchors=25).collect()
    assert len(sampled) == 160
    off = np.array([abs(r["silhouette"] - want[r["id"]]) / r["error"] for r in sampled if r["error"]])
    assert len(off) == 159 and (off < 4).mean() > 0.95
    one = clusters.euclidean_silhouettes(df.where("k = 'y'"), "id", COLS, "k").collect()
    assert {r["silhouette"] for r in one} == {0.0}


def test_diagonal_mixture(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (150, 40)), rng.normal(1.2, 0.5, (250, 40))])
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(40)]).assign(id=range(400))
    rows = clusters.scaled_features(spark.createDataFrame(pdf), [f"x{i}" for i in range(40)])
    model = clusters.diagonal_mixture(rows, 2)
    assert sorted(model.weights) == pytest.approx([150 / 400, 250 / 400], abs=0.01)
    done = clusters.mixture_members(rows, model).select("id", "prediction", "membership").toPandas().sort_values("id")
    assert len(set(done["prediction"][:150])) == 1 and len(set(done["prediction"][150:])) == 1 and (done["membership"] > 0.99).all()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    share, log = model.memberships()(z)
    n = share.sum(axis=0)
    np.testing.assert_allclose(model.means, share.T @ z / n[:, None], atol=1e-3)
    assert log.mean() == pytest.approx(model.log_likelihood / 400, abs=1e-3)
