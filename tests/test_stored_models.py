"""Stored models score raw rows as they did before."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from statloom.learning import models


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest"])
def test_store_and_load(spark, tmp_path, name):
    rows = [(i, float(i % 17), None if i % 9 == 0 else float(i % 5), "abc"[i % 3], int(i % 17 > 8), "train" if i % 4 else "test") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, y int, split string")
    fresh = models.fit_pipeline(df, F.col("y"), ["a", "b"], ["c"], name, trees=5)
    loaded = models.load(models.store(fresh, str(tmp_path / "m")))
    share = lambda m: [(r["id"], r["p"]) for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()]
    assert share(fresh) == share(loaded)
    new = spark.createDataFrame([(1, 3.0, None, "unseen", 0, "test")], df.schema)
    assert loaded.transform(new).count() == 1
    with pytest.raises(Exception):
        models.store(fresh, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        models.fit_pipeline(df, F.col("y"), ["a"], [], "svm_rbf")
