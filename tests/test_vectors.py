"""Small cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from statloom.functions import scalars
from statloom.learning import metrics
from statloom.operators import charts, cleaning, describe, frequency, series
from statloom.runtime import lookup, settle


def column(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def test_rolling_mean_of_three(spark):
    df = column(spark, [60.0, 60.0, 50.0, 50.0, 60.0, 50.0])
    got = [r["rolling_mean_3"] for r in series.rolling(df, "v", ["i"], 3).orderBy("i").collect()]
    assert got[:2] == [None, None]
    assert got[2:] == pytest.approx([56.67, 53.33, 53.33, 53.33], abs=0.01)


def test_fixed_edges(spark):
    df = column(spark, [60.0, 60.0, 50.0, 50.0, 60.0, 230.0])
    got = charts.histogram_fixed(df, "v", 0.0, 300.0, 3).orderBy("bin").collect()
    assert [r["count"] for r in got] == [5, 0, 1]
    assert charts.histogram_fixed(df, "v", 50.0, 60.0, 2).agg(F.sum("count")).first()[0] == 5


def test_pandas_tie_rules(spark):
    df = column(spark, [2.0, 2.0, 9.0, 9.0, 5.0])
    assert describe.mode_of(df, ["v"]).first()["mode"] == 2.0
    assert sorted(r["mode"] for r in describe.all_modes(df, "v").collect()) == [2.0, 9.0]


def test_one_value_has_no_spread(spark):
    r = describe.describe(column(spark, [4.0]), ["v"], shape=True).first()
    assert (r["count"], r["median"], r["std"], r["variance"], r["skew"]) == (1, 4.0, None, None, None)


def test_zero_mean_has_no_cv(spark):
    assert describe.describe(column(spark, [-1.0, 1.0]), ["v"]).first()["cv"] is None


def test_frequency_keeps_missing_and_distribution_does_not(spark):
    df = column(spark, ["a", None, "a", "b"], "string")
    assert {r["v"]: r["relative_frequency"] for r in frequency.frequency(df, "v").collect()} == {"a": 0.5, None: 0.25, "b": 0.25}
    assert {r["v"]: round(r["percent"], 2) for r in frequency.distribution(df, "v").collect()} == {"a": 66.67, "b": 33.33}


def test_bad_cells_become_missing(spark):
    df = column(spark, ["1.5", "?", "NaN", None, " 2 "], "string")
    assert [r[0] for r in df.select(scalars.to_number(F.col("v"))).collect()] == [1.5, None, None, None, 2.0]


def test_flags_and_groups(spark):
    df = column(spark, [None, 1.0, -1.0])
    assert [r[0] for r in df.select(scalars.flag(F.col("v") > 0)).collect()] == [0, 1, 0]
    times = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 05:59:59'), (TIMESTAMP'2024-01-01 06:00:00'), (TIMESTAMP'2024-01-01 18:00:00'), (NULL) AS t(ts)")
    assert [r[0] for r in times.select(scalars.day_or_night(F.col("ts"))).collect()] == [1, 0, 1, 0]


def test_slug(spark):
    df = column(spark, ["  Big Survey -- Health!  "], "string")
    assert df.select(scalars.slug(F.col("v"))).first()[0] == "big_survey_health"


def test_mode_fill_falls_back_to_a_word(spark):
    df = column(spark, [None, None], "string")
    assert {r["v"] for r in cleaning.impute_mode(df, ["v"]).collect()} == {"unknown"}


def test_scores_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "a int, p int")
    r = metrics.binary_metrics(df, "a", "p").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_broadcast(spark, how):
    big = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain, salted = (lookup(big, table, ["k"], how, ["id"], max_rows=m) for m in (100, 5))
    assert plain.count() == salted.count() == big.join(table, "k", how).count()
    assert plain.exceptAll(salted.select(plain.columns)).count() == 0


def test_settle_beyond_the_bound_is_checkpointed(spark):
    df = spark.range(100).withColumn("x", F.rand())
    kept = settle(df, 10)
    assert kept.exceptAll(kept).count() == 0 and kept.count() == 100


def test_empty_tables_give_empty_results(spark):
    empty = spark.createDataFrame([], "id long, g string, x double")
    frames = [
        describe.describe(empty, ["x"], ["g"]),
        describe.trimmed_mean(empty, ["x"], 0.1),
        cleaning.iqr_clip(cleaning.impute_auto(empty), ["x"]),
        cleaning.oversample(empty, "g"),
        charts.box_stats(empty, ["x"], ["g"]),
        series.fill_gaps(empty, ["x"], ["id"]),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
