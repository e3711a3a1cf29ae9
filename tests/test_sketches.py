"""Stored sketches: merged ones stand for the union, estimates keep the stated errors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 60_000
    pdf = pd.DataFrame({"day": np.where(rng.random(n) < 0.4, 0, rng.integers(0, 30, n)), "user": rng.integers(0, 20_000, n), "x": rng.lognormal(1, 2, n)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("user") % 50 == 0, None).when(F.col("user") % 51 == 0, float("nan")).otherwise(F.col("x")))
    pdf.loc[(pdf["user"] % 50 == 0) | (pdf["user"] % 51 == 0), "x"] = np.nan
    return pdf, df.withColumn("name", F.concat(F.lit("u"), "user"))


def test_stored_days_merge_to_ranges(spark, rows, tmp_path):
    pdf, df = rows
    days = sketches.store(sketches.sketch(df, ["day"], ["user", "name", "x"], ["x"]), str(tmp_path / "days"))
    assert days.count() == 30 * 3
    for low, high in ((0, 30), (0, 1), (5, 12), (29, 30)):
        part = pdf[(pdf["day"] >= low) & (pdf["day"] < high)]
        merged = sketches.merge(sketches.load(spark, str(tmp_path / "days")).where(f"day >= {low} AND day < {high}"))
        for r in sketches.distinct_counts(merged).collect():
            exact = part["x" if r["variable"] == "x" else "user"].nunique()
            assert abs(r["estimate"] - exact) <= max(1, exact * sketches.distinct_error())
            assert r["n"] == (part["x"].count() if r["variable"] == "x" else len(part))
        values = np.sort(part["x"].dropna())
        for r in sketches.quantiles(merged, [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
            lo, hi = np.searchsorted(values, [r["estimate"]], "left")[0], np.searchsorted(values, [r["estimate"]], "right")[0]
            assert lo / len(values) <= r["prob"] + sketches.rank_error() and hi / len(values) >= r["prob"] - sketches.rank_error()
        ends = merged.where("variable = 'x'").first()
        assert (ends["least"], ends["most"]) == (values[0], values[-1])


def test_merging_by_expression_and_checks(rows):
    _, df = rows
    days = sketches.sketch(df, ["day"], numeric=["x"])
    weeks = sketches.merge(days, [F.floor(F.col("day") / 7).alias("week")])
    found = sketches.check_quantiles(df.withColumn("week", F.floor(F.col("day") / 7)).where("NOT isnan(x)"), sketches.quantiles(weeks, [0.25, 0.75], ["week"]), ["week"], "x")
    got = found.collect()
    assert len(got) == 10 and all(r["within"] and r["below"] <= r["up_to"] for r in got)


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, float("nan")), (2, "a", 3.0)], "g int, s string, x double")
    got = {(r["g"], r["variable"]): r["n"] for r in sketches.sketch(df, ["g"], ["s"], ["x"]).collect()}
    assert got == {(1, "s"): 0, (1, "x"): 0, (2, "s"): 1, (2, "x"): 1}
    made = sketches.sketch(df, ["g"], ["s"], ["x"])
    assert {(r["g"], r["estimate"]) for r in sketches.distinct_counts(made, ["g"]).collect()} == {(1, 0), (2, 1)}
    assert [(r["g"], r["estimate"]) for r in sketches.quantiles(made, [0.5], ["g"]).collect()] == [(2, 3.0)]
    assert sketches.merge(sketches.sketch(df.limit(0), ["g"], ["s"], ["x"])).count() == 0
