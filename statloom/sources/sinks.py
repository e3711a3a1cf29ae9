"""Writing result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_bundle(frames: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per result table under a common root."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in frames}
    for name, df in frames.items():
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(paths[name])
    return paths


def read_bundle(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.format(fmt).load(path) for name, path in paths.items()}
