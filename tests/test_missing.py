"""NaN counts as missing; keys, digests, blanks and entities that are easily confused stay apart."""

import html

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions.scalars import array_std, unescape
from statloom.learning import metrics
from statloom.operators import cleaning, describe, frequency, series
from statloom.sources.readers import split_blanks


@pytest.fixture(scope="module")
def gaps(spark):
    values = [float("nan"), 1.0, 3.0, None, 8.0, 100.0, 2.0, 4.0]
    return spark.createDataFrame([(i, v, i * 1.5) for i, v in enumerate(values)], "k int, v double, w double")


def column(df, name):
    return pd.Series([r[0] for r in df.orderBy("k").select(name).collect()], dtype=float)


def test_nan_is_missing(gaps):
    raw = column(gaps, "v")
    assert np.allclose(column(cleaning.impute_median(gaps, ["v"]), "v"), raw.fillna(raw.median()))
    assert np.allclose(column(cleaning.impute_mean(gaps, ["v"]), "v"), raw.fillna(raw.mean()))
    q1, q3 = raw.quantile(0.25), raw.quantile(0.75)
    clipped = raw.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert np.allclose(column(cleaning.iqr_clip(gaps, ["v"]), "v"), clipped, equal_nan=True)
    scaled = (raw - raw.min()) / (raw.max() - raw.min())
    assert np.allclose(column(cleaning.min_max(gaps, ["v"]), "v_scaled"), scaled, equal_nan=True)
    assert np.allclose(column(cleaning.standardize(gaps, ["v"]), "v_std"), (raw - raw.mean()) / raw.std(ddof=0), equal_nan=True)
    z = (raw - raw.mean()) / raw.std()
    marked = describe.zscore(gaps, "v", 1.5)
    assert np.allclose(column(marked, "z"), z, equal_nan=True) and column(marked, "is_outlier").tolist() == (z.abs() > 1.5).astype(int).tolist()
    r = {(x["a"], x["b"]): x["r"] for x in describe.correlation(gaps, ["v", "w"]).collect()}
    assert r["v", "w"] == pytest.approx(raw.corr(column(gaps, "w")))


def test_time_split_of_large_keys(spark):
    for start in (2**60, -(2**60), 5):
        rows = spark.range(10).select((F.col("id") + start).alias("k"), F.lit("2024-01-01").cast("timestamp").alias("t"))
        got = series.time_split(rows, "t", "k", 0.5).where("split = 'train'").select("k").collect()
        assert sorted(r[0] for r in got) == [start + i for i in range(5)]


def test_duplicate_rows_keep_values_apart(spark):
    rows = [("a\u0001b", "c"), ("a", "b\u0001c"), (None, "x"), ("\u0000", "x"), ("-", "x"), ("p", None), ("p", None)]
    assert [r["copies"] for r in frequency.duplicate_rows(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).collect()] == [2]


def test_blanks_of_any_kind(spark):
    got = spark.createDataFrame([("\t1  2\t3 ",)], "s string").select(split_blanks(F.col("s"))).first()[0]
    assert got == ["1", "2", "3"]


def test_entities(spark):
    texts = ["&copy; &#233; &#x41;&eacute;", "&amp;lt; &#128512; &#xD800; &#0;", "none", "", None, "&#39;&lt;", "&#38;lt; &#x26;amp;", "&uacute;&Eacute;&#128;&notit; &ampx &CounterClockwiseContourIntegral;"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(unescape(F.col("t"))).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_long_arrays(spark):
    values = np.random.default_rng(1).normal(5, 2, 100_000)
    got = spark.createDataFrame([(values.tolist(),), ([],), (None,)], "a array<double>").select(array_std(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(values.std()) and got[1][0] is None and got[2][0] is None


def test_levels_come_from_the_data(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "y"), ("b", None), (None, "w")], "g string, c string")
    assert frequency.crosstab(df, "g", "c").columns == ["g", "x", "y", "z"]
    assert {r["g"]: r["total"] for r in frequency.crosstab_percent(df, "g", "c").collect()} == {"a": 2, "b": 1}
    assert metrics.confusion(df, "g", "c").count() == 36
    none = df.where("c = 'no'")
    assert frequency.crosstab(none, "g", "c").count() == 0
    assert frequency.crosstab_percent(none, "g", "c").count() == 0
    assert metrics.confusion(none, "g", "c").count() == 0
