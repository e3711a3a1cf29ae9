"""Support vector machines on Fourier features against Spark's own, one for each class."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from statloom.learning.machines import FourierMap, FourierMachines, minimised


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:, 2] = x[:, 2] > 0
    label = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 < 1, 0, np.where(x[:, 0] > 0, 1, 2)).astype(float)
    data = pd.DataFrame({"id": range(400), "x": list(x), "label": label, "weight": rng.choice([0.5, 1.0, 2.0], 400)})
    return spark.createDataFrame(data, "id int, x array<double>, label double, weight double").withColumn("features", array_to_vector("x"))


def test_the_cosine_is_exact_to_the_last_digits():
    fourier, x = FourierMap.drawn(4, 50, None, 1), np.random.default_rng(0).normal(size=(70, 4)) * 30
    plain = np.sqrt(2.0 / 50) * np.cos(2 * np.pi * (x @ fourier.turns + fourier.shift))
    assert np.abs(fourier(x) - plain).max() < 1e-13


def test_the_minimum_of_a_bowl():
    run, middle = minimised(np.zeros(3), 50, 1e-9), np.array([1.0, -2.0, 0.5])
    x = next(run)
    with pytest.raises(StopIteration) as end:
        while True:
            x = run.send((float(((x - middle) ** 2).sum()), 2 * (x - middle)))
    assert end.value.value == pytest.approx(middle, abs=1e-3)


@pytest.mark.parametrize("classes", [2, 3])
def test_same_machines_as_linear_svc(rows, classes):
    train = rows if classes == 3 else rows.where("label < 2")
    model = FourierMachines(7, classes, iterations=10, dims=40).fit(train)
    fourier = FourierMap.drawn(3, 40, None, 7)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2.0 / 40) * np.cos(2 * np.pi * (np.vstack(x.to_numpy()) @ fourier.turns + fourier.shift))) if len(x) else [])

    mapped = train.withColumn("mapped", array_to_vector(project(vector_to_array("features"))))
    svm = LinearSVC(featuresCol="mapped", maxIter=10, regParam=1e-3, weightCol="weight")
    theirs = (OneVsRest(classifier=svm, featuresCol="mapped", weightCol="weight") if classes == 3 else svm).fit(mapped)
    single = theirs.models if classes == 3 else [theirs]
    assert model.coefficients == pytest.approx(np.array([m.coefficients.toArray() for m in single]).T, abs=1e-6)
    assert model.intercepts == pytest.approx([m.intercept for m in single], abs=1e-6)
    both = theirs.transform(mapped).select("id", F.col("prediction").alias("a")).join(model.transform(train).select("id", F.col("prediction").alias("b")), "id")
    assert both.where("a <> b").count() == 0


def test_all_equal_rows(rows):
    one = rows.limit(1).crossJoin(rows.select(F.col("label").alias("of")).limit(9)).withColumn("label", F.lit(1.0))
    assert {r["prediction"] for r in FourierMachines(7).fit(one).transform(one).collect()} == {1.0}


def test_three_classes_share_their_passes(spark, rows):
    """One fit of three classes takes little more jobs than the longest of a single class, and stores no Fourier feature."""

    def jobs(name, classes, table):
        spark.sparkContext.setJobGroup(name, name)
        FourierMachines(7, classes, iterations=8, dims=20).fit(table)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    single = max(jobs(f"rest{c}", 2, rows.withColumn("label", (F.col("label") == c).cast("double"))) for c in range(3))
    assert jobs("all", 3, rows) <= single + 5
