"""Operators against pandas on random data, on the plain and on the distributed path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import charts, cleaning, describe, sampling, selection, series


def frame(rows=3000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(rows) < 0.4, "hot", rng.choice(list("abcde"), rows))
    pdf = pd.DataFrame(
        {
            "id": np.arange(rows),
            "g": g,
            "x": np.where(rng.random(rows) < 0.1, np.nan, rng.normal(50, 20, rows).round(1)),
            "y": rng.exponential(5, rows),
            "flat": 3.0,
        }
    )
    one = pd.DataFrame({"id": [rows], "g": ["single"], "x": [1.5], "y": [2.5], "flat": [3.0]})
    return pd.concat([pdf, one], ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, g string, x double, y double, flat double").repartition(5)


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame()
    return pdf, to_spark(spark, pdf).cache()


@pytest.fixture(params=["whole", "one pass", "narrowed"])
def brackets(request, monkeypatch):
    """Rank groups whole, within sketched brackets, or within brackets narrowed twice."""
    if request.param != "whole":
        monkeypatch.setattr(selection, "WHOLE", 0)
        monkeypatch.setattr(selection, "IN_TASK", 100 if request.param == "one pass" else 1)


def test_describe(data, brackets):
    pdf, df = data
    got = describe.describe(df, ["x", "y", "flat"], ["g"], shape=True).toPandas().set_index(["g", "variable"])
    for (g, part) in pdf.groupby("g"):
        for c in ("x", "y", "flat"):
            s, r = part[c].dropna(), got.loc[(g, c)]
            want = {
                "count": s.count(), "mean": s.mean(), "median": s.median(), "mode": s.mode().iloc[0], "min": s.min(), "max": s.max(),
                "variance": s.var(), "std": s.std(), "cv": s.std() / s.mean(), "p25": s.quantile(0.25), "p75": s.quantile(0.75),
            }
            if c != "flat":
                want |= {"skew": s.skew(), "kurtosis": s.kurt()}
            for k, v in want.items():
                assert r[k] == pytest.approx(v, rel=1e-9, abs=1e-12, nan_ok=True), (g, c, k)


@pytest.mark.parametrize("in_task", [2_000_000, 2_000, 40])
def test_large_group_uses_brackets(spark, monkeypatch, in_task):
    """Far more rows than the sketch keeps whole, with one value holding a third of them."""
    n = 60_000
    values = np.where(np.arange(n) % 3 == 0, 7.0, np.random.default_rng(2).lognormal(2, 1.5, n))
    monkeypatch.setattr(selection, "IN_TASK", in_task)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(6)
    probs = [0.001, 0.1, 0.25, 0.5, 0.75, 0.99, 0.9999]
    got = selection.quantiles(df, ["v"], probs).first()["q"]
    assert got == pytest.approx(pd.Series(values).quantile(probs).tolist(), rel=1e-12)


def test_empty_column_is_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [r["variable"] for r in describe.describe(df, ["a", "b"]).collect()] == ["a"]


def test_mad(data, brackets):
    pdf, df = data
    got = describe.median_abs_deviation(df, ["x"], ["g"]).toPandas().set_index("g")["mad"]
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx((part["x"] - part["x"].median()).abs().median())


def test_trimmed_mean_with_ties(spark):
    values = [1.0] * 5 + [2.0] * 3 + [9.0] * 4
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for alpha in (0.0, 0.1, 0.25, 0.45):
        cut = int(len(values) * alpha)
        kept = sorted(values)[cut : len(values) - cut]
        assert describe.trimmed_mean(df, ["v"], alpha).first()["trimmed_mean"] == pytest.approx(np.mean(kept))


def test_clip_keeps_missing(data):
    pdf, df = data
    q1, q3 = pdf["x"].quantile([0.25, 0.75])
    want = pdf["x"].clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = cleaning.iqr_clip(df, ["x", "flat"]).orderBy("id").toPandas()
    np.testing.assert_allclose(got["x"].astype(float), want)
    assert (got["flat"] == 3.0).all()


@pytest.mark.parametrize("rows_per_task", [None, 40])
@pytest.mark.parametrize("by", [[], ["g"]])
class TestOrdered:
    """Hot and single-row groups, whole series, one block or many."""

    def expected(self, pdf, by, fn):
        return pdf.groupby("g", group_keys=False)["x"].apply(fn) if by else fn(pdf["x"])

    def check(self, pdf, got, column, want):
        got = got.orderBy("id").toPandas()
        assert len(got) == len(pdf)
        np.testing.assert_allclose(got[column].astype(float), want.sort_index().astype(float), rtol=1e-9, atol=1e-9)

    def test_diff(self, data, by, rows_per_task):
        pdf, df = data
        got = series.diff(df, "x", ["id"], by, rows_per_task=rows_per_task)
        self.check(pdf, got, "x_diff", self.expected(pdf, by, lambda s: s.diff()))

    def test_lags(self, data, by, rows_per_task):
        pdf, df = data
        got = series.lag_features(df, "x", ["id"], [1, 24], 24, by, rows_per_task=rows_per_task)
        self.check(pdf, got, "lag_24", self.expected(pdf, by, lambda s: s.shift(24)))
        self.check(pdf, got, "rolling_mean_24", self.expected(pdf, by, lambda s: s.shift(1).rolling(24).mean()))

    def test_rolling(self, data, by, rows_per_task):
        pdf, df = data
        got = series.rolling(df, "x", ["id"], 3, by, std=True, rows_per_task=rows_per_task)
        self.check(pdf, got, "rolling_mean_3", self.expected(pdf, by, lambda s: s.rolling(3).mean()))
        self.check(pdf, got, "rolling_std_3", self.expected(pdf, by, lambda s: s.rolling(3).std()))

    @pytest.mark.parametrize("method", ["ffill", "bfill", "interpolate"])
    def test_fill(self, data, by, rows_per_task, method):
        pdf, df = data
        pdf, df = pdf.copy(), df.withColumn("x", F.when(~F.col("id").between(5, 150) & (F.col("id") < 2900), F.col("x")))
        pdf.loc[pdf["id"].between(5, 150) | (pdf["id"] >= 2900), "x"] = np.nan
        fn = {
            "ffill": lambda s: s.ffill(),
            "bfill": lambda s: s.bfill(),
            "interpolate": lambda s: s.interpolate(method="linear").ffill().bfill(),
        }[method]
        got = series.fill_gaps(df, ["x"], ["id"], by, method, rows_per_task)
        self.check(pdf, got, "x", self.expected(pdf, by, fn))


def test_category_codes_in_blocks(spark):
    df = spark.range(500).select(F.format_string("c%05d", F.col("id") * 7 % 501).alias("c"))
    coded = series.over_rows(df.distinct(), ["c"], lambda w, s: F.row_number().over(w) + s - 1, rows_per_task=30)
    rows = coded.orderBy("c").collect()
    assert [r["code"] for r in rows] == list(range(500))


@pytest.mark.parametrize("share", [0.0, 0.31, 0.8, 1.0])
def test_time_split_with_a_hot_time(spark, share):
    pdf = pd.DataFrame({"id": range(1000), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.r_[np.zeros(400), np.arange(600)] // 1, unit="min")})
    pdf = pdf.sample(frac=1, random_state=3)
    got = series.time_split(spark.createDataFrame(pdf), "t", "id", share).where("split = 'train'").toPandas()
    want = pdf.sort_values(["t", "id"]).head(int(share * 1000))
    assert sorted(got["id"]) == sorted(want["id"])


def test_samples_are_exact(data):
    pdf, df = data
    for n in (0, 1, 100, len(pdf), len(pdf) + 10):
        assert sampling.sample_exact(df, "id", n).count() == min(n, len(pdf))
    sizes = sampling.cap_per_class(df, "id", "g", 300).groupBy("g").count().collect()
    for r in sizes:
        assert r["count"] == min(300, (pdf["g"] == r["g"]).sum())
    parts = sampling.stratified_split(df, "id", "g").groupBy("g", "split").count().collect()
    for r in parts:
        if r["split"] == "train":
            assert r["count"] == int(np.ceil(0.8 * (pdf["g"] == r["g"]).sum()))
    assert sampling.sample_exact(df, "id", 50).exceptAll(sampling.sample_exact(df.repartition(3), "id", 50)).count() == 0


def test_head_of_a_large_group(data):
    pdf, df = data
    small = sampling.head_per_group(df, "g", ["id"], 2).count()
    assert small == sum(min(2, n) for n in pdf.groupby("g").size())
    big = sampling.head_per_group(df.withColumn("k", F.lit(1)), "k", ["id"], 1001).agg(F.max("id"), F.count("id")).first()
    assert tuple(big) == (1000, 1001)


def test_histogram_matches_numpy(data):
    pdf, df = data
    got = charts.histogram(df, ["x"], 25).orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf["x"].dropna(), bins=25)
    assert abs(got["count"].to_numpy() - counts).sum() <= 2  # a value on an inner edge may fall to either side
    np.testing.assert_allclose(got["midpoint"], (edges[:-1] + edges[1:]) / 2)
    flat = charts.histogram(df, ["flat"], 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [len(pdf), 0, 0, 0]


def test_ridgeline_matches_convolution(data):
    pdf, df = data
    got = charts.density_by_group(df, "y", "g", 0.0, 20.0, 40, smooth=True).toPandas()
    kernel = np.array([1, 2, 3, 2, 1]) / 9
    assert "single" not in set(got["g"])
    for g, part in pdf.groupby("g"):
        if len(part) < 2:
            continue
        d, _ = np.histogram(part["y"], bins=np.linspace(0, 20, 41), density=True)
        d = np.convolve(d, kernel, mode="same")
        np.testing.assert_allclose(got[got["g"] == g].sort_values("bin")["density"], d / d.max() * 0.85, rtol=1e-9)


def test_one_pass_states(data, brackets):
    """Both states from value counts are those of the table and of its imputed, clipped form."""
    _, df = data
    df = df.withColumns({"gone": F.lit(None).cast("double"), "x": F.when(F.col("id") % 50 == 3, float("nan")).otherwise(F.col("x"))})
    cols = ["x", "y", "flat", "gone"]
    cleaned = cleaning.iqr_clip(cleaning.impute_median(df, cols), cols)
    keys = ["state", "variable"]
    want = cleaning.states(df, cleaned, cols).toPandas().sort_values(keys, ignore_index=True)
    got = cleaning.cleaned_states(df, cols).toPandas().sort_values(keys, ignore_index=True)
    assert len(want) == 6
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)
    want = cleaning.compare_states(df, cleaned, cols).toPandas().sort_values("variable", ignore_index=True)
    got = cleaning.compare_cleaned(df, cols).toPandas().sort_values("variable", ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)


def test_one_pass_states_of_nothing(data):
    _, df = data
    for few in (df.limit(0), df.withColumn("x", F.lit(None).cast("double"))):
        assert cleaning.cleaned_states(few, ["x"]).count() == 0 and cleaning.compare_cleaned(few, ["x"]).count() == 0
    one = cleaning.cleaned_states(df.where("g = 'single'"), ["x"]).collect()
    assert {r["state"] for r in one} == {"raw", "cleaned"} and all(r["std"] is None and r["mean"] == 1.5 for r in one)
