"""Summary tables too large to broadcast: joins with salted keys give the same rows, also for a hot group of equal values."""

import numpy as np
import pandas as pd
import pytest

from statloom import runtime
from statloom.operators import charts, cleaning, describe, frequency

CASES = {
    "describe": lambda df: describe.describe(df, ["x", "y"], ["g"]),
    "mad": lambda df: describe.median_abs_deviation(df, ["x", "y"], ["g"]),
    "mean deviation": lambda df: describe.mean_abs_deviation(df, ["x", "y"], ["g"]),
    "trimmed": lambda df: describe.trimmed_mean(df, ["x", "y"], 0.1, ["g"]),
    "outliers": lambda df: describe.outlier_counts(df, ["x", "y"], ["g"]),
    "boxes": lambda df: charts.box_stats(df, ["x", "y"], ["g"]),
    "histogram": lambda df: charts.histogram(df, ["x", "y"], 7, ["g"]),
    "residuals": lambda df: charts.residual_histogram(df, "x", "y", 5, ["g"]),
    "codes": lambda df: cleaning.encode(df, "g"),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    g = np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 200, 3000).astype(str))
    pdf = pd.DataFrame({"id": range(3000), "g": g, "x": np.where(g == "hot", 7.0, rng.normal(size=3000)), "y": rng.exponential(size=3000)})
    df = spark.createDataFrame(pdf).selectExpr("id", "IF(id % 11 = 0, NULL, g) AS g", "IF(id % 13 = 0, NULL, x) AS x", "y")
    return df.repartition(6).cache()


@pytest.mark.parametrize("name", CASES)
def test_same_without_broadcast(rows, monkeypatch, name):
    keys = [c for c in ("g", "variable", "bin", "id") if c in CASES[name](rows).columns]
    want = CASES[name](rows).toPandas().sort_values(keys, ignore_index=True)
    monkeypatch.setattr(runtime, "local_or_none", lambda df, max_rows=0: None)
    got = CASES[name](rows).toPandas().sort_values(keys, ignore_index=True)
    assert len(want)
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)


def test_equal_rows_of_a_hot_key_spread(spark, monkeypatch):
    monkeypatch.setattr(runtime, "local_or_none", lambda df, max_rows=0: None)
    big = spark.range(4000, numPartitions=64).selectExpr("1 AS k", "5.0 AS v")
    joined = runtime.lookup(big, spark.createDataFrame([(1, "a")], "k int, name string"), ["k"])
    salted = [c for c in joined.columns]
    assert salted == ["k", "v", "name"] and joined.count() == 4000


def test_only_hot_keys_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(runtime, "local_or_none", lambda df, max_rows=0: None)
    monkeypatch.setattr(runtime, "HOT_ROWS", 100)
    big = spark.range(2000, numPartitions=16).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 1 WHEN id % 4 = 1 THEN NULL ELSE id END AS k")
    table = spark.range(3000).selectExpr("id AS k", "id * 2 AS twice")
    plan = runtime.lookup(big, table, ["k"], "left")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "strategy=merge" in plan  # never a broadcast of repeated rows
    for how in ("left", "inner"):
        want = sorted(map(str, big.join(table, ["k"], how).collect()))
        assert sorted(map(str, runtime.lookup(big, table, ["k"], how).collect())) == want
    few = runtime.lookup(big.where("id > 1900"), table, ["k"], "left")
    assert "Generate" not in few._jdf.queryExecution().toString() and few.count() == 99


def test_labels_of_many_rows_are_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(runtime, "local_or_none", lambda df, max_rows=0: None)
    facts = spark.range(500).selectExpr("id % 400 AS k", "id")
    labels = spark.range(300).unionByName(spark.range(20)).selectExpr("id AS k", "id % 2 AS good")
    joined = frequency.label_lookup(facts, labels, "k")
    plan = joined._jdf.queryExecution().toString()
    assert "Generate" not in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(str, joined.collect())) == sorted(map(str, facts.join(labels, ["k"], "left").collect()))
