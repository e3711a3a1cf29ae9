"""Scores of predictions as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.describe import stack
from statloom.operators.frequency import levels_of


def confusion(df: DataFrame, actual: str, predicted: str, classes: Sequence | None = None) -> DataFrame:
    """Counts of every (actual, predicted) pair of the classes (by default all that occur), empty pairs as 0.

    Without any class the table is empty.
    """
    classes = levels_of(df, actual, predicted) if classes is None else classes
    if not classes:
        return df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), F.lit(0).cast("bigint").alias("count")).where("false")
    pairs = [(a, p) for a in classes for p in classes]
    counts = df.agg(
        *[F.count(F.when((F.col(actual) == F.lit(a)) & (F.col(predicted) == F.lit(p)), 1)).alias(f"c{i}") for i, (a, p) in enumerate(pairs)]
    )
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{i}").alias("count")) for i, (a, p) in enumerate(pairs)]
    return counts.select(F.inline(F.array(*cells)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def binary_metrics(df: DataFrame, actual: str, predicted: str, positive=1) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class."""
    t, p = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(actual) == F.col(predicted), 1)).alias("right"),
        F.count(F.when(t & p, 1)).alias("tp"),
        F.count(F.when(~t & p, 1)).alias("fp"),
        F.count(F.when(t & ~p, 1)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "n",
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class seen in either column."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    hit = F.when(F.col("a") == F.col("p"), F.col("c")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = stack(
        [
            pairs.select(F.col("a").alias("class"), F.col("c").alias("support"), zero.alias("named"), hit.alias("tp")),
            pairs.select(F.col("p").alias("class"), zero.alias("support"), F.col("c").alias("named"), zero.alias("tp")),
        ]
    )
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "named", "tp")])
    return sums.select(
        "class",
        "support",
        ratio(F.col("tp"), F.col("named")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("named") + F.col("support")).alias("f1"),
    )


def macro_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy with the unweighted means of the class scores."""
    scores = per_class(df, actual, predicted)
    right = F.sum(F.col("recall") * F.col("support"))
    return scores.agg(
        F.sum("support").alias("n"),
        (right / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE over max(actual, 1), R2 and the spread of both columns, in one aggregate."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            (F.avg(F.abs(e) / F.greatest(y, F.lit(1.0))) * 100).alias("mape"),
            (1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
            F.stddev_samp(y).alias("std_actual"),
            F.stddev_samp(p).alias("std_predicted"),
        )
    )
