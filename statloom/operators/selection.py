"""Exact order statistics without sorting or collecting a group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here
a group that is too large to be ranked by one task is sketched first, and the
sketch brackets each wanted rank; while a bracket may still hold too many rows, a
further sketch of the rows inside narrows it. The last pass folds all rows outside the brackets into counts before the
shuffle and keeps exact values only inside them, so the answer is exact and the
sketch stays small whatever the size of the table. A rank that a bracket missed
raises an error instead of giving a wrong value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.runtime import lookup, settle

GRID = 250
"""Even shares at which a sketch is read."""

ACCURACY = 1_000
"""Sketch accuracy; its rank error is a quarter of a grid step."""

WHOLE = 20_000
"""Groups up to this size are ranked without brackets."""

IN_TASK = 2_000_000
"""Rows a bracket may hold before it is narrowed again."""

WIDTH = 6 / GRID
"""Largest share of the rows that a bracket keeps per pass."""


@dataclass(frozen=True)
class Rank:
    """A wanted position: its 1-based place among n values."""

    place: Callable[[Column], Column]


def linear(p: float) -> Rank:
    """Place (n - 1) p + 1: linear interpolation between closest ranks."""
    return Rank(lambda n: (n - 1) * F.lit(float(p)) + 1)


def weibull(p: float) -> Rank:
    """Place (n + 1) p, kept inside 1..n."""
    return Rank(lambda n: F.greatest(F.lit(1.0), F.least(n.cast("double"), (n + 1) * F.lit(float(p)))))


def trim_low(alpha: float) -> Rank:
    """First value kept after cutting floor(alpha n) from below."""
    return Rank(lambda n: (F.floor(n * F.lit(float(alpha))) + 1).cast("double"))


def trim_high(alpha: float) -> Rank:
    """Last value kept after cutting floor(alpha n) from above."""
    return Rank(lambda n: (n - F.floor(n * F.lit(float(alpha)))).cast("double"))


def nth(k: int) -> Rank:
    """The k-th smallest."""
    return Rank(lambda n: F.lit(float(k)))


def long_form(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, variable, value) with missing values and groups dropped."""
    base = df.dropna(subset=list(by)) if by else df
    doubles = base.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = doubles.unpivot(list(by), list(cols), "variable", "value")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def grid_column(value: Column | str = "value") -> Column:
    """Sketched values at even shares, as an aggregate."""
    return F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _narrow(rank: Rank, grid: Column, below: Column, inside: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """New bracket of a rank among ``inside`` rows that follow ``below`` others.

    Two grid steps are left on each side. A bracket that turns out not to hold
    its rank is given up for the whole range.
    """
    place = rank.place(F.col("n"))
    first, last = F.floor(place), F.ceil(place)
    i = (F.floor((first - 1 - below) / inside * GRID) - 2).cast("int")
    j = (F.ceil((last - below) / inside * GRID) + 2).cast("int")
    held = (first > below) & (last <= below + inside) & (F.col("n") > WHOLE)
    lo = F.when(~held, float("-inf")).when(i <= 0, low).otherwise(F.get(grid, i))
    hi = F.when(~held, float("inf")).when(j >= GRID, high).otherwise(F.get(grid, j))
    return lo, hi


def _refined(rows: DataFrame, keys: list[str], spans: DataFrame, ranks: Sequence[Rank]) -> DataFrame:
    """One more pass: count what lies below and inside each bracket, sketch the inside."""
    v = F.col("value")
    edges = [f"{e}{i}" for i in range(len(ranks)) for e in ("_lo", "_hi")]
    aggs = []
    for i in range(len(ranks)):
        inside = (v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}"))
        aggs += [
            F.count(F.when(v < F.col(f"_lo{i}"), 1)).alias(f"_below{i}"),
            F.count(F.when(inside, 1)).alias(f"_in{i}"),
            grid_column(F.when(inside, v)).alias(f"_grid{i}"),
        ]
    seen = lookup(rows, spans, keys).groupBy(*keys, "n", *edges).agg(*aggs)
    out = []
    for i, r in enumerate(ranks):
        inside = F.nullif(F.col(f"_in{i}"), F.lit(0))
        lo, hi = _narrow(
            r, F.col(f"_grid{i}"), F.col(f"_below{i}"), F.coalesce(inside, F.lit(1)), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        )
        out += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    return seen.select(*keys, "n", *out)


def spans_of(rows: DataFrame, keys: Sequence[str], sizes: DataFrame, ranks: Sequence[Rank]) -> DataFrame | None:
    """Bracket of each rank per key, narrowed until it fits a task; None if all groups do."""
    keys = list(keys)
    bottom, top = F.lit(float("-inf")), F.lit(float("inf"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= IN_TASK:
        return None
    sketch = settle(rows.groupBy(*keys).agg(F.count("value").alias("n"), grid_column().alias("grid")))
    out = []
    for i, r in enumerate(ranks):
        lo, hi = _narrow(r, F.col("grid"), F.lit(0), F.col("n"), bottom, top)
        out += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    spans = sketch.select(*keys, "n", *out)
    held = largest * WIDTH
    while held > IN_TASK:
        spans = settle(_refined(rows, keys, spans, ranks))
        held *= WIDTH
    return spans


def value_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values per key with their count ``c``; equal values merge before the shuffle."""
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))


def _folded(rows: DataFrame, keys: list[str], spans: DataFrame, ranks: int) -> DataFrame:
    """Counts of the values inside any bracket, and of all the rows between two brackets as one."""
    weight = F.col("c") if "c" in rows.columns else F.lit(1)
    joined = lookup(rows.withColumn("_w", weight), spans.drop("n"), keys)
    v = F.col("value")
    folded = F.struct(F.lit(float("inf")).alias("at"), F.lit(0).alias("exact"))
    for i in reversed(range(ranks)):
        folded = (
            F.when(v < F.col(f"_lo{i}"), F.struct(F.col(f"_lo{i}").alias("at"), F.lit(0).alias("exact")))
            .when(v <= F.col(f"_hi{i}"), F.struct(v.alias("at"), F.lit(1).alias("exact")))
            .otherwise(folded)
        )
    return (
        joined.select(*keys, folded.alias("_f"), "_w")
        .groupBy(*keys, F.col("_f.at").alias("at"), F.col("_f.exact").alias("exact"))
        .agg(F.sum("_w").alias("c"))
    )


def pick(
    rows: DataFrame,
    keys: Sequence[str],
    sizes: DataFrame,
    ranks: Sequence[Rank],
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact values at ``ranks`` per key as array ``q``: (keys, n, q).

    ``sizes`` is a settled table with the keys and ``n``; ranks are in ascending
    order. Value ``counts`` are read instead of the rows if at hand.
    """
    keys = list(keys)
    spans = spans_of(rows, keys, sizes, ranks)
    if spans is None:
        counts = value_counts(rows, keys) if counts is None else counts
        counted = counts.select(*keys, F.col("value").alias("at"), F.lit(1).alias("exact"), "c")
    else:
        counted = _folded(rows if counts is None else counts, keys, spans, len(ranks))
    run = Window.partitionBy(*keys).orderBy("at", "exact").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("cum", F.sum("c").over(run)).join(sizes.select(*keys, "n"), keys)
    picks = []
    for i, r in enumerate(ranks):
        place = r.place(F.col("n"))
        for name, pos in ((f"_a{i}", F.floor(place)), (f"_b{i}", F.ceil(place))):
            hit = (F.col("cum") >= pos) & (F.col("cum") - F.col("c") < pos) & (F.col("exact") == 1)
            picks.append(F.max(F.when(hit, F.col("at"))).alias(name))
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    values = []
    for i, r in enumerate(ranks):
        place = r.place(F.col("n"))
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        missed = a.isNull() | b.isNull()
        exact = a + (b - a) * (place - F.floor(place))
        values.append(F.when(missed, F.raise_error(F.lit("rank outside its bracket")).cast("double")).otherwise(exact))
    return found.select(*keys, "n", F.array(*values).alias("q"))


def order_statistics(rows: DataFrame, keys: Sequence[str], ranks: Sequence[Rank]) -> DataFrame:
    """Exact values at ``ranks`` of column ``value`` per key: (keys, n, q array)."""
    return pick(rows, keys, settle(rows.groupBy(*keys).agg(F.count("value").alias("n"))), ranks)


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    method: Callable[[float], Rank] = linear,
) -> DataFrame:
    """Exact quantiles of many columns: (by, variable, n, q array in the order of ``probs``)."""
    rows = long_form(df, cols, by)
    return order_statistics(rows, [*by, "variable"], [method(p) for p in sorted(probs)])
