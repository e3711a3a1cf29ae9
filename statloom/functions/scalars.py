"""Column expressions shared by the operators."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def to_number(col: Column) -> Column:
    """Text to double; anything unreadable, and NaN, becomes null."""
    value = col.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def to_time(col: Column, pattern: str) -> Column:
    """Text to timestamp by pattern; unreadable text becomes null."""
    return F.try_to_timestamp(col, F.lit(pattern))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def without_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN is missing: null in its place, in the floating columns among those named."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")} & set(cols)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols if c in floats}) if floats else df


def clip(col: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Keep values inside the bounds; missing stays missing."""
    value = col
    if low is not None:
        value = F.greatest(value, low)
    if high is not None:
        value = F.least(value, high)
    return F.when(col.isNotNull(), value)


def recode(col: Column, mapping: Mapping) -> Column:
    """Translate codes by a fixed mapping; unknown codes stay as text."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), col.cast("string"))


def day_or_night(ts: Column) -> Column:
    """0 from 06:00 up to 18:00, else 1; a missing time counts as day."""
    hour = F.hour(ts)
    return F.when(hour.isNull() | ((hour >= 6) & (hour < 18)), 0).otherwise(1)


def first_prefix(col: Column, prefixes: Sequence[str], default: str = "general") -> Column:
    """The first of the prefixes the text starts with."""
    out = F.lit(default)
    for prefix in reversed(prefixes):
        out = F.when(col.startswith(prefix), F.lit(prefix)).otherwise(out)
    return out


def slug(col: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def words(col: Column) -> Column:
    """All words of a text, letters and digits of any script."""
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def word_count(col: Column) -> Column:
    return F.size(words(col))


def sentences(col: Column) -> Column:
    """Number of stretches between full stops, exclamation and question marks that hold a word."""
    parts = F.split(col, "[.!?]+")
    return F.size(F.filter(parts, lambda s: F.regexp_like(s, F.lit(WORD))))


def unescape(col: Column) -> Column:
    """Replace all HTML5 character references, named or numeric, in one pass: what a reference gives is not decoded again.

    The names are those of Python's own table, so the work is an Arrow-batched function.
    """

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, "string")(col)


def half_even(col: Column, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, halves to the even neighbour."""
    return F.bround(col, digits)


def rounded(df: DataFrame, digits: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """A table for display: fractional columns (or those named) rounded half to even."""
    fractional = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "decimal")]
    return df.withColumns({c: half_even(F.col(c), digits) for c in (fractional if cols is None else cols)})


def squeeze(col: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def order_hash(key: Column, seed: int) -> Column:
    """Text whose order is a repeatable shuffle of the rows."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_bucket(digest: Column) -> Column:
    """First 12 bits of the hash: 4096 even slices in hash order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def array_mean(arr: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.nullif(F.size(arr), F.lit(0))


def array_std(arr: Column) -> Column:
    """Population deviation of the elements, in one pass over them (count, mean, squared distance)."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        off = x.cast("double") - acc["mean"]
        mean = acc["mean"] + off / (acc["n"] + 1.0)
        return F.struct((acc["n"] + 1.0).alias("n"), mean.alias("mean"), (acc["m2"] + off * (x.cast("double") - mean)).alias("m2"))

    return F.aggregate(arr, zero, step, lambda acc: F.sqrt(acc["m2"] / F.nullif(acc["n"], F.lit(0.0))))


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon of the given side that holds (x, y)."""
    q = (x * (3.0**0.5) / 3.0 - y / 3.0) / size
    r = y * (2.0 / 3.0) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_worst = (dq > dr) & (dq > ds)
    cell_q = F.when(q_worst, -rr - rs).otherwise(rq)
    cell_r = F.when(~q_worst & (dr > ds), -rq - rs).otherwise(rr)
    return cell_q.cast("int"), cell_r.cast("int")
