"""Training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.learning.machines import FourierMachines
from statloom.learning.metrics import binary_metrics, macro_metrics, regression_metrics
from statloom.operators.describe import stack
from statloom.operators.frequency import class_weights
from statloom.operators.series import over_rows
from statloom.runtime import fixed, lookup

SEED = 42


def preparation(numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True) -> Pipeline:
    """Median imputation and scaling of numbers, mode-first indexing and one-hot of categories.

    Category columns are expected without gaps; a category unseen in training
    becomes a vector of zeros.
    """
    filled = [f"{c}_filled" for c in numeric]
    stages: list[Estimator] = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    stages.append(VectorAssembler(inputCols=filled, outputCol="numbers"))
    parts = ["numbers"]
    if scale:
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True))
        parts = ["scaled"]
    if categorical:
        indexed, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True))
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def with_class_weight(df: DataFrame, target: str) -> DataFrame:
    """Add the balanced class weight of each row."""
    return lookup(df, class_weights(df, target).select(target, "weight"), [target])


def classifiers(trees: int = 120, classes: int = 2, weighted: bool = True) -> dict[str, tuple[Estimator | FourierMachines, str]]:
    """The baseline classifiers with the features each one learns from: ``mapped`` are Fourier features that it makes itself."""
    weight = {"weightCol": "weight"} if weighted else {}
    return {
        "logistic_regression": (LogisticRegression(maxIter=100, **weight), "features"),
        "random_forest": (RandomForestClassifier(numTrees=trees, seed=SEED, weightCol="weight"), "features"),
        "svm_rbf": (FourierMachines(SEED, classes), "mapped"),
    }


def fit_pipeline(
    df: DataFrame, target: Column, numeric: Sequence[str], categorical: Sequence[str], name: str = "logistic_regression", split: str = "split", **sizes
) -> PipelineModel:
    """Preparation and classifier as one model of raw rows, fitted on the training rows; classifiers on ``mapped`` are not offered."""
    estimator, source = classifiers(**sizes)[name]
    if source != "features":
        raise ValueError(f"{name} reads features that no stored stage makes")
    labelled = fixed(with_class_weight(df.where(F.col(split) == "train").withColumn("label", target.cast("double")), "label"))
    return Pipeline(stages=[*preparation(numeric, categorical).getStages(), estimator]).fit(labelled)


def store(model: PipelineModel, path: str) -> str:
    """Save a fitted model, all its stages, in a folder that every executor reaches; an earlier one there is an error."""
    model.write().save(path)
    return path


def load(path: str) -> PipelineModel:
    """A stored model, ready for ``transform`` on raw rows."""
    return PipelineModel.load(path)


def fit_classifier(
    name: str, train: DataFrame, test: DataFrame, trees: int = 120, classes: int = 2, weighted: bool = True
) -> DataFrame:
    """Predictions of one baseline classifier on prepared rows (``features``, ``label``)."""
    estimator, _ = classifiers(trees, classes, weighted)[name]
    return estimator.fit(with_class_weight(train, "label")).transform(test)


def prepare(
    df: DataFrame, target: Column, numeric: Sequence[str], categorical: Sequence[str], split: str = "split", scale: bool = True
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Fit the preparation on training rows only and apply it to both parts.

    The rows are fixed before and after, since every training pass reads them again.
    """
    labelled = fixed(df.withColumn("label", target.cast("double")))
    model = preparation(numeric, categorical, scale).fit(labelled.where(F.col(split) == "train"))
    ready = fixed(model.transform(labelled))
    return ready.where(F.col(split) == "train"), ready.where(F.col(split) == "test"), model


def classification_scores(
    train: DataFrame, test: DataFrame, dataset: str, names: Sequence[str], trees: int = 120, classes: int = 2
) -> DataFrame:
    """One row of test scores per classifier; macro means for more than two classes."""
    rows = []
    for name in names:
        pred = fit_classifier(name, train, test, trees, classes)
        if classes > 2:
            scored = macro_metrics(pred, "label", "prediction").withColumnsRenamed(
                {"macro_precision": "precision", "macro_recall": "recall", "macro_f1": "f1"}
            )
        else:
            scored = binary_metrics(pred, "label", "prediction", 1.0)
        rows.append(
            scored.select(
                F.lit("classification").alias("task"),
                F.lit(dataset).alias("dataset"),
                F.lit(name).alias("model"),
                F.col("n").alias("test_rows"),
                "accuracy",
                "precision",
                "recall",
                "f1",
            )
        )
    return stack(rows)


def regressors(trees: int = 120, boosts: int = 300) -> dict[str, Estimator]:
    """The baseline regressors."""
    return {
        "linear_regression": LinearRegression(),
        "random_forest": RandomForestRegressor(numTrees=trees, seed=SEED),
        "boosted_trees": GBTRegressor(maxIter=boosts, maxDepth=5, stepSize=0.05, seed=SEED),
    }


def predictions(
    train: DataFrame, test: DataFrame, models: Mapping[str, Estimator], keep: Sequence[str]
) -> tuple[DataFrame, dict]:
    """Stacked (keep, actual, predicted, model) rows and the fitted models."""
    fitted = {name: m.fit(train) for name, m in models.items()}
    frames = [
        m.transform(test).select(
            *keep, F.col("label").alias("actual"), F.col("prediction").alias("predicted"), F.lit(name).alias("model")
        )
        for name, m in fitted.items()
    ]
    return stack(frames), fitted


def regression_scores(predicted: DataFrame, dataset: str) -> DataFrame:
    """Scores per model of a stacked predictions table."""
    scores = regression_metrics(predicted, "actual", "predicted", ["model"])
    return scores.select(F.lit("regression").alias("task"), F.lit(dataset).alias("dataset"), "model", F.col("n").alias("test_rows"), "mae", "rmse", "mape", "r2")


def importances(model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """Feature importances by name, largest first."""
    pairs = sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in pairs], "feature string, importance double")


def ar2_fit(df: DataFrame, col: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Least-squares y(t) = c + a1 y(t-1) + a2 y(t-2) per entity, from one grouped aggregate.

    The last two values of each entity come along as the start of a forecast.
    """
    def lags(w, _):
        return {"_y1": F.lag(col, 1).over(w), "_y2": F.lag(col, 2).over(w)}
    rows = over_rows(df.select(*by, *order, col), order, lags, by, lookback=2)
    full = F.col("_y2").isNotNull() & F.col("_y1").isNotNull() & F.col(col).isNotNull()
    y, x1, x2 = (F.when(full, F.col(c)) for c in (col, "_y1", "_y2"))
    last = F.max(F.struct(*order, F.col(col).alias("y"), F.col("_y1").alias("y1")))
    sums = rows.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("my"),
        F.avg(x1).alias("m1"),
        F.avg(x2).alias("m2"),
        F.var_pop(x1).alias("v1"),
        F.var_pop(x2).alias("v2"),
        F.covar_pop(x1, x2).alias("c12"),
        F.covar_pop(x1, y).alias("c1"),
        F.covar_pop(x2, y).alias("c2"),
        last.alias("last"),
    )
    det = F.nullif(F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12"), F.lit(0.0))
    a1 = (F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12")) / det
    a2 = (F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12")) / det
    return sums.withColumns({"a1": a1, "a2": a2}).select(
        *by,
        "n",
        (F.col("my") - F.col("a1") * F.col("m1") - F.col("a2") * F.col("m2")).alias("intercept"),
        "a1",
        "a2",
        F.col("last.y").alias("y_last"),
        F.col("last.y1").alias("y_before"),
    )


def ar2_forecast(fit: DataFrame, steps: int, by: Sequence[str]) -> DataFrame:
    """Repeated one-step forecasts of each entity, ``steps`` ahead."""
    start = F.struct(
        F.col("y_last").alias("y1"), F.col("y_before").alias("y2"), F.array().cast("array<double>").alias("path")
    )
    def step(s: Column, _: Column) -> Column:
        y = F.col("intercept") + F.col("a1") * s["y1"] + F.col("a2") * s["y2"]
        return F.struct(y.alias("y1"), s["y1"].alias("y2"), F.concat(s["path"], F.array(y)).alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["path"])
    return fit.select(*by, F.posexplode(path).alias("i", "forecast")).select(
        *by, (F.col("i") + 1).alias("step"), "forecast"
    )


def ar2_held_out(df: DataFrame, col: str, order: Sequence[str], split: str = "split") -> DataFrame:
    """(order, actual, predicted, model) of the test rows of one series, forecast from its training rows only."""
    df = fixed(df)
    fit = ar2_fit(df.where(F.col(split) == "train"), col, order, [])
    test = over_rows(df.where(F.col(split) == "test").select(*order, col), order, lambda w, before: {"step": (F.row_number().over(w) + before).cast("int")})
    ahead = ar2_forecast(fit, max(test.count(), 1), [])
    return test.join(ahead, "step").select(*order, F.col(col).cast("double").alias("actual"), F.col("forecast").alias("predicted"), F.lit("ar2").alias("model"))


def simple_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R2 of a one-variable least-squares line."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
