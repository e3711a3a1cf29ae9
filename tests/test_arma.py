"""ARMA models: known coefficients, plain least squares, blocks, missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.learning import arma
from statloom.operators import series


def simulate(n, seed, c=2.0, ar=(0.5, -0.3), ma=(0.4, 0.2)):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n), np.zeros(n)
    for t in range(2, n):
        y[t] = c + ar[0] * y[t - 1] + ar[1] * y[t - 2] + e[t] + ma[0] * e[t - 1] + ma[1] * e[t - 2]
    return y


def plain(y, p=2, q=2, m=6):
    """Both regressions by numpy's least squares."""
    def lagged(v, k):
        return np.concatenate([np.full(k, np.nan), v[:-k]])
    def solve(target, columns):
        x = np.column_stack([np.ones(len(target)), *columns])
        ok = ~np.isnan(x).any(axis=1) & ~np.isnan(target)
        return np.linalg.lstsq(x[ok], target[ok], rcond=None)[0], x, ok.sum()
    b, x, _ = solve(y, [lagged(y, i) for i in range(1, m + 1)])
    e = y - x @ b
    b, _, n = solve(y, [lagged(y, i) for i in range(1, p + 1)] + [lagged(e, i) for i in range(1, q + 1)])
    return b, e, n


@pytest.fixture(scope="module")
def table(spark):
    frames = [pd.DataFrame({"g": g, "t": range(n), "y": simulate(n, s)}) for g, n, s in (("hot", 6000, 1), ("b", 300, 2), (None, 400, 3))]
    frames[1].loc[[50, 51, 120], "y"] = np.nan
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(6)


@pytest.mark.parametrize("rows_per_task", [None, 700])
def test_same_as_least_squares(table, monkeypatch, rows_per_task):
    if rows_per_task:
        monkeypatch.setattr(series, "ROWS_PER_TASK", rows_per_task)
    pdf, df = table
    got = {r["g"]: r for r in arma.fit(df, "y", ["t"], ["g"]).collect()}
    assert set(got) == {"hot", "b", None}
    for g, r in got.items():
        y = pdf[pdf["g"].isna() if g is None else pdf["g"] == g]["y"].to_numpy()
        b, e, n = plain(y)
        assert r["n"] == n
        assert [r["intercept"], r["ar1"], r["ar2"], r["ma1"], r["ma2"]] == pytest.approx(b.tolist(), rel=1e-6, abs=1e-8)
        assert r["y_last"] == pytest.approx(y[-1:-3:-1].tolist()) and r["e_last"] == pytest.approx(e[-1:-3:-1].tolist(), abs=1e-8)
    assert [got["hot"][c] for c in ("ar1", "ar2", "ma1", "ma2")] == pytest.approx([0.5, -0.3, 0.4, 0.2], abs=0.12)


def test_forecasts_and_held_out(spark, table):
    pdf, df = table
    model = arma.fit(df.where("g = 'b'"), "y", ["t"])
    r = model.first()
    got = [x["forecast"] for x in arma.forecast(model, 4).orderBy("step").collect()]
    ys, es, want = list(r["y_last"]), list(r["e_last"]), []
    for _ in range(4):
        new = r["intercept"] + r["ar1"] * ys[0] + r["ar2"] * ys[1] + r["ma1"] * es[0] + r["ma2"] * es[1]
        want.append(new)
        ys, es = [new, ys[0]], [0.0, es[0]]
    assert got == pytest.approx(want)
    rows = df.where("g = 'hot'").withColumn("split", F.when(F.col("t") < 5900, "train").otherwise("test"))
    scored = arma.held_out(rows, "y", ["t"]).toPandas()
    assert len(scored) == 100 and set(scored["model"]) == {"arma"}
    assert ((scored["actual"] - scored["predicted"]) ** 2).mean() < 3 * np.var(pdf[pdf["g"] == "hot"]["y"])


def test_short_flat_and_empty(spark):
    schema = "g string, t int, y double"
    flat = spark.createDataFrame([("flat", i, 1.0) for i in range(30)] + [("short", i, float(i % 2)) for i in range(3)], schema)
    got = {r["g"]: r for r in arma.fit(flat, "y", ["t"], ["g"]).collect()}
    assert got["flat"]["ar1"] is None and got["short"]["n"] == 0 and got["short"]["intercept"] is None
    assert arma.fit(flat.limit(0), "y", ["t"], ["g"]).count() == 0
