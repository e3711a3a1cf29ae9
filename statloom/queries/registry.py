"""Registration of queries and small helpers they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def holed(df: DataFrame, cols: dict[str, int], key: str) -> DataFrame:
    """Blank a column where the key is a multiple of the given number."""
    return df.withColumns({c: F.when(F.col(key) % n == 0, None).otherwise(F.col(c)) for c, n in cols.items()})


def holed_sql(name: str, keep: Sequence[str], cols: dict[str, int], key: str) -> str:
    """The same blanks in SQL."""
    parts = [*keep, *[f"CASE WHEN {key} % {n} = 0 THEN NULL ELSE {c} END AS {c}" for c, n in cols.items()]]
    return f"SELECT {', '.join(parts)} FROM {name}"


def long_sql(source: str, cols: Sequence[str], by: Sequence[str] = ()) -> str:
    """One row per (group, variable, value) without missing values."""
    keys = "".join(f"{b}, " for b in by)
    return " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {source} WHERE {c} IS NOT NULL" for c in cols
    )
