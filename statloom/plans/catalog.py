"""Dataset settings and the semantic type of each variable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from statloom.operators.cleaning import numeric_columns


@dataclass(frozen=True)
class Dataset:
    """What the recipe needs to know about a table."""

    name: str
    target: str
    selected: Sequence[str]
    categorical: Sequence[str] = ()
    time: str | None = None
    positive: object = 1
    descriptions: dict[str, str] = field(default_factory=dict)


def variable_types(df: DataFrame, data: Dataset) -> DataFrame:
    """One row per column: its type by setting first, then by storage type."""
    numbers = set(numeric_columns(df))

    def kind(c: str) -> tuple[str, str]:
        if c == data.target:
            return "target", "target"
        if c == data.time:
            return "datetime", "time_index"
        if c in data.categorical:
            return "qualitative", "feature"
        return ("quantitative_continuous_or_ordinal" if c in numbers else "qualitative"), "feature"

    rows = [(data.name, c, *kind(c), data.descriptions.get(c), c in data.selected) for c in df.columns]
    schema = "dataset string, variable string, type string, role string, description string, selected boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def columns_named(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that exist."""
    return [c for c in wanted if c in df.columns]


def find_column(df: DataFrame, word: str) -> str:
    """The first column whose name contains the word, else the last column."""
    return next((c for c in df.columns if word.lower() in c.lower()), df.columns[-1])
