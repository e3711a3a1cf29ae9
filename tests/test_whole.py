"""Queries that once did a part of the job."""

import oracle
from pyspark.sql import functions as F

from statloom.learning import clusters, models
from statloom.queries import QUERIES, SQL, learning

SF = "/root/testdata/sf0.001"


def test_silhouette_and_profile_read_every_dimension(spark):
    assert set(learning.DIMS) <= set(QUERIES["q_cluster_profile_all"](spark, SF).columns)
    two = clusters.point_silhouettes(learning.points(spark, SF), "vec_id", ["x1", "x2"], "label")
    sums = [df.agg(F.sum("silhouette")).first()[0] for df in (two, *(QUERIES[n](spark, SF) for n in ("q_silhouette", "q_silhouette_all")))]
    assert abs(sums[0] - sums[1]) > 1e-6 and abs(sums[1] - sums[2]) < 1e-9


def test_comparison_clusters_all_dimensions(spark):
    rows = learning.scaled_points(spark, SF)
    got = {r["algorithm"]: r["silhouette"] for r in QUERIES["q_cluster_comparison"](spark, SF).collect()}
    model = clusters.cluster_models(2)["kmeans"].fit(rows.select("features"))
    assert abs(got["kmeans"] - clusters.silhouette(model.transform(rows))) < 0.02 and len(got) == 3


def test_every_model_is_compared(spark, monkeypatch):
    regressors, scored = models.regressors, models.classification_scores
    monkeypatch.setattr(models, "regressors", lambda **_: regressors(trees=2, boosts=2))
    monkeypatch.setattr(models, "classification_scores", lambda *a: scored(*a, trees=2))
    wanted = {*regressors(), "ar2"}
    got = {(r["task"], r["model"]) for r in QUERIES["q_model_comparison"](spark, SF).collect()}
    assert got == {("classification", n) for n in models.classifiers()} | {("regression", n) for n in wanted}
    counts = {r["model"]: r["count"] for r in QUERIES["q_predictions"](spark, SF).groupBy("model").count().collect()}
    assert set(counts) == wanted and len(set(counts.values())) == 1


def test_held_out_forecast(spark):
    y = [1.0, 3.0]
    while len(y) < 40:
        y.append(0.5 + 0.6 * y[-1] - 0.3 * y[-2])
    rows = spark.createDataFrame([(i, v, "train" if i < 30 else "test") for i, v in enumerate(y)], "t int, y double, split string")
    got = models.ar2_held_out(rows, "y", ["t"]).orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(30, 40)) and all(abs(r["actual"] - r["predicted"]) < 1e-4 for r in got)


def test_tagged_records_hold_whole_texts(spark, tmp_path):
    texts = ["<b>x</b> &amp; a&lt;b\n\n c > d", "é ß 你好 😀 &#65; “q”", "</BODY></RECORD> &nbsp;", " \t ", None, "wörd\n" * 20_000]
    rows = [(i, t, "en", "web", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["newid"]: r["body"] for r in QUERIES["q_read_tagged_text"](spark, str(tmp_path)).collect()}
    assert got == {i: " ".join((t or "").split()) for i, t in enumerate(texts)}
    assert oracle.difference(QUERIES["q_read_tagged_text"](spark, SF), SQL["q_read_tagged_text"], oracle.connect(SF)) is None
