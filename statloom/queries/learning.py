"""Scores, models and clusterings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from statloom.functions.scalars import sentences, word_count
from statloom.learning import boosting, clusters, metrics, models, ward
from statloom.operators import sampling, series
from statloom.operators.describe import stack
from statloom.queries.charts import persistence
from statloom.queries.registry import query, table
from statloom.runtime import fixed, scratch

RULED = """
t AS (SELECT l.quality AS actual, CAST(length(d.text) >= 500 AS INTEGER) AS predicted FROM labels l JOIN documents d USING (doc_id))
"""
STATUS = """
t AS (SELECT o_orderstatus AS actual,
             CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS predicted FROM orders)
"""
HOURS = """
h AS (SELECT event_type, date_trunc('hour', ts) AS hour_start, avg(value) AS y FROM events GROUP BY ALL),
l AS (SELECT *, lag(y, 1) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour_start)),
s AS (SELECT event_type, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2,
             covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM l WHERE x2 IS NOT NULL GROUP BY event_type),
e AS (SELECT event_type, arg_max(y, hour_start) AS y_last, arg_max(x1, hour_start) AS y_before FROM l GROUP BY event_type),
fit AS (SELECT event_type, n, my - m1 * (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) - m2 * (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS intercept,
               (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS a1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS a2, y_last, y_before
        FROM s JOIN e USING (event_type))
"""
DIMS = [f"x{i + 1}" for i in range(64)]
NUMBERS = ["n_chars", "word_count", "sentences"]
LABELS = ["lang", "source"]
LAGGED = ["hour", "dayofweek", "is_weekend", "lag_1", "lag_24", "rolling_mean_24"]


def ruled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.char_length("text") >= 500).cast("int").alias("predicted"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("actual")).join(docs, "doc_id")


def status(spark, sf):
    price = F.col("o_totalprice")
    rule = F.when(price > 300000, "F").when(price > 150000, "O").otherwise("P")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("actual"), rule.alias("predicted"))


def points(spark, sf, dims=len(DIMS)):
    arr = F.col("embedding")
    cols = [F.get(arr, i).cast("double").alias(f"x{i + 1}") for i in range(dims)]
    return table(spark, sf, "embeddings").select("vec_id", "label", *cols)


def labelled_documents(spark, sf):
    """Document features with the quality label, split within each class."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        word_count(F.col("text")).cast("double").alias("word_count"),
        sentences(F.col("text")).cast("double").alias("sentences"),
        *LABELS,
    )
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    return sampling.stratified_split(rows, "doc_id", "quality")


def prepared_documents(spark, sf, scale=True):
    train, test, _ = models.prepare(labelled_documents(spark, sf), F.col("quality"), NUMBERS, LABELS, scale=scale)
    return train, test


def hourly_rows(spark, sf):
    """The hourly series with calendar and lag features, split by time."""
    hours = series.hourly(table(spark, sf, "events"), "ts", ["value"])
    rows = series.lag_features(hours, "value", ["hour_start"], [1, 24], 24).dropna()
    rows = series.calendar(rows, "hour_start").drop("month")
    rows = rows.withColumn("hour_key", F.unix_seconds(F.col("hour_start").cast("timestamp")))
    return series.time_split(rows, "hour_start", "hour_key")


def prepared_hours(spark, sf, scale=True):
    rows = hourly_rows(spark, sf).withColumns({c: F.col(c).cast("double") for c in LAGGED})
    train, test, _ = models.prepare(rows, F.col("value"), LAGGED, [], scale=scale)
    return train, test


def scored_regressor(spark, sf, name, **sizes):
    train, test = prepared_hours(spark, sf, scale=name == "linear_regression")
    rows, _ = models.predictions(train, test, {name: models.regressors(**sizes)[name]}, ["hour_start"])
    return models.regression_scores(rows, "hourly events")


def ar_predictions(spark, sf):
    """The test hours forecast from the training hours alone, as far ahead as they reach."""
    return models.ar2_held_out(hourly_rows(spark, sf).select("hour_start", "value", "split"), "value", ["hour_start"])


@query(f"""
WITH {RULED}, p AS (SELECT a.v AS actual, b.v AS predicted FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v))
SELECT actual, predicted, count(t.actual) AS count FROM p LEFT JOIN t USING (actual, predicted) GROUP BY actual, predicted
""")
def q_confusion_matrix(spark, sf):
    return metrics.confusion(ruled(spark, sf), "actual", "predicted")


@query(f"""
WITH {RULED}, c AS (SELECT count(*) AS n, count(*) FILTER (actual = predicted) AS r, count(*) FILTER (actual = 1 AND predicted = 1) AS tp,
  count(*) FILTER (actual = 0 AND predicted = 1) AS fp, count(*) FILTER (actual = 1 AND predicted = 0) AS fn FROM t)
SELECT n, r / n::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
       coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM c
""")
def q_binary_metrics(spark, sf):
    return metrics.binary_metrics(ruled(spark, sf), "actual", "predicted")


CLASS_SQL = f"""
WITH {STATUS}, k AS (SELECT DISTINCT actual AS class FROM t UNION SELECT DISTINCT predicted FROM t),
c AS (SELECT class, count(*) FILTER (actual = class) AS support, count(*) FILTER (predicted = class) AS named,
             count(*) FILTER (actual = class AND predicted = class) AS tp FROM k, t GROUP BY class),
m AS (SELECT class, support, coalesce(tp / nullif(named, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
             coalesce(2 * tp / nullif(named + support, 0)::DOUBLE, 0) AS f1, tp FROM c)
"""


@query(f"{CLASS_SQL} SELECT * EXCLUDE (tp) FROM m")
def q_class_metrics(spark, sf):
    return metrics.per_class(status(spark, sf), "actual", "predicted")


@query(f"""
{CLASS_SQL}
SELECT sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support)::DOUBLE AS accuracy, avg(precision) AS macro_precision,
       avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM m
""")
def q_macro_metrics(spark, sf):
    return metrics.macro_metrics(status(spark, sf), "actual", "predicted")


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour_start, avg(value) AS y FROM events GROUP BY ALL),
l AS (SELECT *, lag(y) OVER (PARTITION BY event_type ORDER BY hour_start) AS p FROM h),
t AS (SELECT * FROM l WHERE p IS NOT NULL)
SELECT event_type, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p) / greatest(y, 1)) * 100 AS mape,
       1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2, stddev_samp(y) AS std_actual, stddev_samp(p) AS std_predicted
FROM t GROUP BY event_type
""")
def q_regression_metrics(spark, sf):
    return metrics.regression_metrics(persistence(spark, sf), "actual", "predicted", ["event_type"])


PROFILE = f"""
SELECT label, {", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS {c}" for i, c in enumerate(DIMS))}, count(*) AS n,
       avg(CAST(embedding[3] > 0 AS INTEGER)) * 100 AS share_percent FROM embeddings GROUP BY label
"""


@query(PROFILE)
def q_cluster_profile(spark, sf):
    return clusters.profile(points(spark, sf), "label", DIMS, F.col("x3") > 0)


@query(PROFILE)
def q_cluster_profile_all(spark, sf):
    return q_cluster_profile(spark, sf)


SILHOUETTE = """
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM p),
q AS (SELECT vec_id, label, sum(x * x) AS q FROM u GROUP BY ALL),
c AS (SELECT label AS other, count(*) AS n, sum(q) AS ss FROM q GROUP BY label),
s AS (SELECT label AS other, i, sum(x) AS sx FROM u GROUP BY ALL),
t AS (SELECT vec_id, label, other, sum(x * sx) AS xs FROM u JOIN s USING (i) GROUP BY ALL),
d AS (SELECT vec_id, t.label, other, n, greatest((n * q - 2 * xs + ss) / CASE WHEN other = t.label THEN greatest(n - 1, 1) ELSE n END, 0) AS dist
      FROM t JOIN q USING (vec_id) JOIN c USING (other)),
ab AS (SELECT vec_id, label, max(dist) FILTER (other = label) AS a, min(dist) FILTER (other <> label) AS b,
              max(n) FILTER (other = label) AS n FROM d GROUP BY vec_id, label)
SELECT vec_id, label, CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS silhouette FROM ab
"""


@query(SILHOUETTE)
def q_silhouette(spark, sf):
    return clusters.point_silhouettes(points(spark, sf), "vec_id", DIMS, "label")


@query(SILHOUETTE)
def q_silhouette_all(spark, sf):
    return q_silhouette(spark, sf)


@query("""
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS far, count(*) AS n FROM p a, p b GROUP BY a.vec_id, a.label, b.label),
d AS (SELECT vec_id, label, other, n, far / CASE WHEN label = other THEN greatest(n - 1, 1) ELSE n END AS dist FROM s),
ab AS (SELECT vec_id, label, max(dist) FILTER (other = label) AS a, min(dist) FILTER (other <> label) AS b, max(n) FILTER (other = label) AS n FROM d GROUP BY ALL)
SELECT vec_id, label, CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS silhouette, 0::DOUBLE AS error FROM ab
""")
def q_silhouette_euclidean(spark, sf):
    """Plain Euclidean silhouettes; exact, since no label has more rows than there are anchors at the scales compared."""
    return clusters.euclidean_silhouettes(points(spark, sf), "vec_id", DIMS, "label")


def ward_sql(bits: int) -> str:
    side = lambda b: " + ".join(f"{'-' if bin(b & i).count('1') % 2 else ''}(embedding[{i + 1}]::DOUBLE - m{i + 1})" for i in range(len(DIMS)))
    means = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS m{i + 1}" for i in range(len(DIMS)))
    cell = " + ".join(f"{2 ** (b - 1)} * ({side(b)} > 0)::BIGINT" for b in range(1, bits + 1))
    sums = ", ".join(f"sum(embedding[{i + 1}]::DOUBLE) AS s{i + 1}" for i in range(len(DIMS)))
    norm = " + ".join(f"embedding[{i + 1}]::DOUBLE * embedding[{i + 1}]::DOUBLE" for i in range(len(DIMS)))
    return f"WITH m AS (SELECT {means} FROM embeddings), c AS (SELECT embedding, ({cell})::BIGINT AS cell FROM embeddings, m) SELECT cell, count(*) AS n, sum({norm}) AS ss, {sums} FROM c GROUP BY cell"


@query(ward_sql(ward.BITS))
def q_ward_features(spark, sf):
    """The micro-clusters that Ward's hierarchy merges."""
    return ward.micro_clusters(points(spark, sf), DIMS)[1]


@query()
def q_ward(spark, sf):
    """Profile of two clusters of Ward's hierarchy, over all dimensions."""
    rows, features = ward.micro_clusters(points(spark, sf), DIMS)
    return clusters.profile(ward.assign(rows, ward.fit(features, len(DIMS)), 2), "cluster", DIMS)


@query("""
SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
       regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY l_returnflag
""")
def q_simple_regression(spark, sf):
    return models.simple_regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query(f"WITH {HOURS} SELECT * FROM fit")
def q_ar_fit(spark, sf):
    hours = series.hourly(table(spark, sf, "events"), "ts", ["value"], ["event_type"])
    return models.ar2_fit(hours, "value", ["hour_start"], ["event_type"])


@query(f"""
WITH RECURSIVE {HOURS},
f AS (SELECT event_type, 1 AS step, intercept + a1 * y_last + a2 * y_before AS forecast, y_last AS prev FROM fit
      UNION ALL
      SELECT f.event_type, f.step + 1, intercept + a1 * f.forecast + a2 * f.prev, f.forecast FROM f JOIN fit USING (event_type) WHERE f.step < 24)
SELECT event_type, step, forecast FROM f
""")
def q_ar_forecast(spark, sf):
    return models.ar2_forecast(q_ar_fit(spark, sf), 24, ["event_type"])


@query("""
WITH s AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2,
  covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2 FROM lineitem),
a AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS a1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS a2 FROM s)
SELECT 'intercept' AS term, my - m1 * a1 - m2 * a2 AS coefficient FROM a
UNION ALL SELECT 'l_quantity', a1 FROM a UNION ALL SELECT 'l_discount', a2 FROM a
""")
def q_linreg(spark, sf):
    names = ["l_quantity", "l_discount"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(table(spark, sf, "lineitem"))
    model = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(rows)
    values = [("intercept", float(model.intercept)), *zip(names, map(float, model.coefficients))]
    return spark.createDataFrame(values, "term string, coefficient double")


@query()
def q_linreg_scores(spark, sf):
    return scored_regressor(spark, sf, "linear_regression")


@query()
def q_rf_regressor(spark, sf):
    return scored_regressor(spark, sf, "random_forest")


@query()
def q_gbt_regressor(spark, sf):
    return scored_regressor(spark, sf, "boosted_trees")


TREE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def tree_sql(features: list[str], label: str) -> str:
    """One tree of depth 2 from all values of the features: starting score 0, squared loss, lambda 1."""
    value = lambda g, h: f"{g} * {g} / ({h} + 1)"
    long = " UNION ALL ".join(f"SELECT id, g, {i} AS f, '{c}' AS feature, {c}::DOUBLE AS x FROM r" for i, c in enumerate(features))

    def level(k: int, nodes: str) -> str:
        return f"""
b{k} AS (SELECT node, f, feature, x, sum(g) AS g, count(*)::DOUBLE AS h FROM v JOIN {nodes} USING (id) GROUP BY ALL),
c{k} AS (SELECT *, sum(g) OVER (w ORDER BY x) AS gl, sum(h) OVER (w ORDER BY x) AS hl, sum(g) OVER w AS gt, sum(h) OVER w AS ht FROM b{k} WINDOW w AS (PARTITION BY node, f)),
s{k} AS (SELECT node, f, feature, x AS threshold, {value("gl", "hl")} + {value("(gt - gl)", "(ht - hl)")} - {value("gt", "ht")} AS gain FROM c{k} WHERE hl >= 1 AND ht - hl >= 1),
t{k} AS (SELECT * FROM s{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, threshold) = 1),
n{k} AS (SELECT id, 2 * node + (x > threshold)::INTEGER AS node FROM {nodes} JOIN t{k} USING (node) JOIN v USING (id, f))"""

    return f"""
WITH r AS (SELECT row_number() OVER () AS id, -{label} AS g, {", ".join(features)} FROM lineitem),
v AS ({long}), n0 AS (SELECT id, 1 AS node FROM r),{level(1, "n0")},{level(2, "n1")},
every AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2),
t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2)
SELECT node, any_value(feature) AS feature, any_value(threshold) AS threshold, any_value(gain) AS gain, -sum(g) / (count(*) + 1) AS weight, count(*) AS n
FROM every JOIN r USING (id) LEFT JOIN t USING (node) GROUP BY node
"""


@query(tree_sql(TREE_FEATURES, "l_extendedprice"))
def q_boosted_tree(spark, sf):
    """One second-order tree of depth 2 over all of ``lineitem``, exact over every value of its features."""
    settings = boosting.Settings(trees=1, depth=2, rate=1.0, base=0.0)
    model = boosting.fit(table(spark, sf, "lineitem"), TREE_FEATURES, "l_extendedprice", settings)
    return spark.createDataFrame(model.table(), boosting.TREE_TABLE).drop("tree")


HOUR_ROWS = "h AS (SELECT count(*) - 24 AS n FROM (SELECT date_trunc('hour', ts) FROM events GROUP BY 1))"


@query(f"""
WITH {HOUR_ROWS}
SELECT model, n - floor(0.8 * n)::BIGINT AS test_rows, 24 AS trees, true AS above_mean, true AS as_good FROM h, (VALUES ('second_order')) m(model)
""")
def q_boosted_scores(spark, sf):
    """Second-order trees on the hourly series: whether they beat the mean on the training hours, and come within 2 % of (or beat) the
    first-order trees' test error at the same number, depth and rate."""
    rows = fixed(hourly_rows(spark, sf).withColumns({c: F.col(c).cast("double") for c in LAGGED}))
    train, test = (rows.where(F.col("split") == part) for part in ("train", "test"))
    trees, depth, rate = 24, 3, 0.1
    model = boosting.fit(train, LAGGED, "value", boosting.Settings(trees=trees, depth=depth, rate=rate, max_bins=32))
    first = GBTRegressor(labelCol="value", maxIter=trees, maxDepth=depth, stepSize=rate, seed=models.SEED)
    vectors = VectorAssembler(inputCols=LAGGED, outputCol="features")
    other = first.fit(vectors.transform(train)).transform(vectors.transform(test))
    error = lambda df: df.agg(F.sqrt(F.avg((F.col("value") - F.col("prediction")) ** 2)), F.stddev_pop("value"), F.count(F.lit(1))).first()
    fitted, held_out, theirs = error(model.predict(train)), error(model.predict(test)), error(other)
    found = [("second_order", int(held_out[2]), trees, bool(fitted[0] < fitted[1]), bool(held_out[0] <= 1.02 * theirs[0]))]
    return spark.createDataFrame(found, "model string, test_rows long, trees int, above_mean boolean, as_good boolean")


@query("""
WITH d AS (SELECT l.quality AS actual FROM labels l JOIN documents USING (doc_id))
SELECT model, actual, count(*) AS n, true AS same FROM d, (VALUES ('logistic_regression'), ('random_forest')) m(model) GROUP BY ALL
""")
def q_stored_models(spark, sf):
    """Models stored in one place and loaded in another: rows by class, and whether every loaded score equals the fresh one."""
    rows, scored = fixed(labelled_documents(spark, sf)), []
    for name in ("logistic_regression", "random_forest"):
        fresh = models.fit_pipeline(rows, F.col("quality"), NUMBERS, LABELS, name, trees=20)
        loaded = models.load(models.store(fresh, f"{scratch(spark)}-model"))
        share = vector_to_array("probability")[1]
        one = fresh.transform(rows).select("doc_id", F.col("quality").alias("actual"), share.alias("fresh"))
        two = loaded.transform(rows).select("doc_id", share.alias("loaded"))
        both = one.join(two, "doc_id").groupBy("actual").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("fresh") == F.col("loaded")).alias("same"))
        scored.append(both.select(F.lit(name).alias("model"), "actual", "n", "same"))
    return stack(scored)


@query()
def q_predictions(spark, sf):
    train, test = prepared_hours(spark, sf)
    rows, _ = models.predictions(train, test, models.regressors(), ["hour_start"])
    return stack([rows, ar_predictions(spark, sf)])


@query()
def q_feature_importance(spark, sf):
    train, _ = prepared_hours(spark, sf, scale=False)
    fitted = models.regressors()["random_forest"].fit(train)
    return models.importances(fitted, LAGGED, train)


@query()
def q_ml_features(spark, sf):
    train, test = prepared_documents(spark, sf)
    return train.unionByName(test).select("doc_id", "split", "label", vector_to_array("features").alias("features"))


def scored_classifier(spark, sf, name):
    train, test = prepared_documents(spark, sf)
    return models.classification_scores(train, test, "document quality", [name])


@query()
def q_logreg(spark, sf):
    return scored_classifier(spark, sf, "logistic_regression")


@query()
def q_rf_classifier(spark, sf):
    return scored_classifier(spark, sf, "random_forest")


@query()
def q_rff_svm(spark, sf):
    return scored_classifier(spark, sf, "svm_rbf")


@query()
def q_three_class(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.weekday("o_orderdate").cast("double").alias("day")
    )
    rows = sampling.stratified_split(orders, "o_orderkey", "o_orderstatus")
    code = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    train, test, _ = models.prepare(rows, code, ["o_totalprice", "day"], ["o_orderpriority"])
    return models.classification_scores(train, test, "order status", ["logistic_regression", "random_forest", "svm_rbf"], classes=3)


@query()
def q_model_comparison(spark, sf):
    train, test = prepared_documents(spark, sf)
    scores = models.classification_scores(train, test, "document quality", list(models.classifiers()))
    regression = [scored_regressor(spark, sf, n) for n in models.regressors()]
    held_out = models.regression_scores(ar_predictions(spark, sf), "hourly events")
    return stack([scores, *regression, held_out], fill_missing=True)


def scaled_points(spark, sf, dims=DIMS):
    return clusters.scaled_features(points(spark, sf), dims)


@query()
def q_kmeans_sweep(spark, sf):
    return clusters.kmeans_sweep(scaled_points(spark, sf), range(2, 9))


@query()
def q_gmm(spark, sf):
    rows = scaled_points(spark, sf)
    done = clusters.mixture_members(rows, clusters.diagonal_mixture(rows, 2))
    return done.select("vec_id", F.col("prediction").alias("cluster"), "membership")


@query()
def q_bisecting(spark, sf):
    rows = clusters.shifted(scaled_points(spark, sf))
    model = clusters.cluster_models(2)["bisecting"].fit(rows)
    return clusters.profile(model.transform(rows).withColumnRenamed("prediction", "cluster"), "cluster", DIMS)


@query()
def q_cluster_comparison(spark, sf):
    return clusters.compare_clusterings(scaled_points(spark, sf), 2, "embeddings")


@query("""
WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, (1 + r) / 2 AS explained FROM r UNION ALL SELECT 2, (1 - r) / 2 FROM r
""")
def q_pca_variance(spark, sf):
    rows = clusters.scaled_features(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    _, explained = clusters.pca(rows, "l_orderkey")
    return spark.createDataFrame(list(enumerate(explained, 1)), "component int, explained double")


@query()
def q_pca(spark, sf):
    return clusters.pca(scaled_points(spark, sf), "vec_id")[0]
