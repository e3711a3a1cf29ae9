"""The standard study of a table: clean it, describe both states, tabulate, compare."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from statloom.operators.cleaning import clip_limits, clipped_share, compare_states, impute_auto, iqr_clip, states
from statloom.operators.describe import correlation, group_describe, missing
from statloom.operators.frequency import frequency_many
from statloom.plans.catalog import Dataset, columns_named, variable_types


def study(df: DataFrame, data: Dataset) -> dict[str, DataFrame]:
    """All result tables of one dataset by name."""
    filled = impute_auto(df, skip=[data.target])
    limits = clip_limits(filled, data.selected)
    cleaned = iqr_clip(filled, data.selected, limits=limits)
    tables = {
        "variable_types": variable_types(df, data),
        "missing_values": missing(df),
        "summary": states(df, cleaned, data.selected),
        "preprocessing_comparison": compare_states(df, cleaned, data.selected),
        "frequencies": frequency_many(df, columns_named(df, [data.target, *data.categorical])),
        "group_stats": group_describe(df, data.selected, data.target),
        "correlation": correlation(cleaned, data.selected),
        "cleaned": cleaned,
    }
    if limits:
        tables["clipped_share"] = clipped_share(filled, limits)
    return tables


def study_all(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Dataset]]) -> tuple[dict, DataFrame]:
    """Study every dataset; a failing one is recorded and does not stop the others."""
    results, log = {}, []
    for name, (df, data) in tables.items():
        try:
            results[name] = study(df, data)
            log.append((name, "ok", None))
        except Exception as error:
            log.append((name, "failed", f"{type(error).__name__}: {error}"))
    return results, spark.createDataFrame(log, "dataset string, status string, error string")


