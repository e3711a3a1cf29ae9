"""Second-order trees against a plain numpy version of the same greedy search."""

import numpy as np
import pandas as pd
import pytest

from statloom.learning import boosting
from statloom.learning.boosting import Settings


def plain(x, y, s, base):
    """Scores of the rows after boosting, missing values below all others."""
    x = np.where(np.isnan(x), -np.inf, x)
    score = np.full(len(y), base)
    for _ in range(s.trees):
        if s.loss == "squared":
            g, h = score - y, np.ones(len(y))
        else:
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)

        def grow(rows, depth):
            weight = -g[rows].sum() / (h[rows].sum() + s.reg_lambda)
            best = None
            if depth < s.depth:
                for f in range(x.shape[1]):
                    for t in np.unique(x[rows, f])[:-1]:
                        left = rows[x[rows, f] <= t]
                        right = rows[x[rows, f] > t]
                        if min(h[left].sum(), h[right].sum()) < s.min_child_weight:
                            continue
                        v = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.reg_lambda)
                        gain = v(left) + v(right) - v(rows)
                        if gain > s.gamma and (best is None or gain > best[0] + 1e-9):
                            best = gain, left, right
            if best is None:
                step[rows] = weight
            else:
                grow(best[1], depth + 1)
                grow(best[2], depth + 1)

        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        score = score + s.rate * step
    return score


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    a, b = rng.integers(0, 12, n).astype(float), np.round(rng.normal(size=n), 1)
    y = np.sin(a) + (b > 0.3) * a + rng.normal(0, 0.1, n)
    a[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": rng.integers(0, 3, n).astype(float), "y": y, "z": (y > y.mean()).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize(
    "s",
    [
        Settings(trees=3, depth=3, rate=0.5),
        Settings(trees=10, depth=1, rate=0.3, reg_lambda=0.0, min_child_weight=30.0),
        Settings(trees=2, depth=4, rate=1.0, gamma=5.0, loss="logistic", reg_lambda=2.0),
    ],
)
def test_same_as_plain(data, s):
    pdf, df = data
    label = "y" if s.loss == "squared" else "z"
    model = boosting.fit(df, ["a", "b", "c"], label, s)
    want = plain(pdf[["a", "b", "c"]].to_numpy(), pdf[label].to_numpy(), s, model.base)
    got = df.select("a", "b", "c", label, model.score().alias("score")).toPandas()
    key = ["a", "b", "c", label]
    merged = got.sort_values([*key, "score"])["score"].to_numpy()
    expected = pdf.assign(score=want).sort_values([*key, "score"])["score"].to_numpy()
    np.testing.assert_allclose(merged, expected, rtol=1e-7, atol=1e-9)


def test_many_values_use_quantile_bins(data):
    pdf, df = data
    edges = boosting.bin_edges(df, ["b", "c"], 8)
    assert len(edges[0]) <= 8 and edges[1] == [0.0, 1.0]
    model = boosting.fit(df, ["a", "b"], "y", Settings(trees=12, depth=3, rate=0.3, max_bins=8))
    got = model.predict(df).toPandas()
    assert ((got["prediction"] - got["y"]) ** 2).mean() < 0.3 * got["y"].var()
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > 0


def test_labels_and_odd_tables(spark):
    schema = "a double, y double"
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, None), (5.0, float("nan"))], schema)
    model = boosting.fit(df, ["a"], "y", Settings(trees=2, depth=2))
    assert model.base == 3.0 and all(len(t) == 1 for t in model.trees)
    assert [r["prediction"] for r in model.predict(df).collect()] == [3.0] * 4
    one_sided = spark.createDataFrame([(None, 0.0)] * 5 + [(1.0, 10.0)] * 5, schema)
    tree = boosting.fit(one_sided, ["a"], "y", Settings(trees=1, depth=2, reg_lambda=0.0, rate=1.0)).trees[0]
    assert sorted((n.number, n.weight) for n in tree.values() if n.feature is None) == [(2, -5.0), (3, 5.0)]
    empty = boosting.fit(df.limit(0), ["a"], "y", Settings(trees=1, depth=1))
    assert empty.base == 0.0 and len(empty.trees[0]) == 1
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], "y", Settings(loss="other"))
