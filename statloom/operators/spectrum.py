"""Fourier features of sliding windows of regularly sampled series.

Time is cut into slots of equal length and the values of a slot are averaged. A window is a run of ``samples`` slots and
starts at every ``hop``-th slot since 1970. Each slot goes to the few windows that hold it, and a window, never a series,
meets in one task, so a long series needs no sort and has no hot group. All windows of an Arrow batch are transformed at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def powers(x: np.ndarray) -> np.ndarray:
    """One-sided power of each row at 0, 1, ... n // 2 cycles; a row's powers sum to its mean square."""
    n = x.shape[1]
    p = np.abs(np.fft.rfft(x, axis=1) / n) ** 2
    p[:, 1 : (n + 1) // 2] *= 2
    return p


def windows(df: DataFrame, ts: str, col: str, every: int, samples: int, hop: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, window_start, x): the slot means of each window that has a value in all its slots, in order; ``every`` is in seconds."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(every * 1_000_000))
    value = F.col(col).cast("double")
    known = df.where(F.col(ts).isNotNull() & value.isNotNull() & ~F.isnan(value))
    slots = known.groupBy(*by, slot.alias("_slot")).agg(F.avg(value).alias("_v"))
    first, last = F.ceil((F.col("_slot") - (samples - 1)) / F.lit(hop)), F.floor(F.col("_slot") / F.lit(hop))
    held = slots.where(first <= last).withColumn("_window", F.explode(F.sequence(first, last)))
    held = held.groupBy(*by, "_window").agg(F.sort_array(F.collect_list(F.struct("_slot", "_v"))).alias("_all"))
    start = F.timestamp_seconds(F.col("_window") * F.lit(hop * every)).cast("timestamp_ntz")
    return held.where(F.size("_all") == samples).select(*by, start.alias("window_start"), F.col("_all._v").alias("x"))


def band_powers(
    df: DataFrame,
    ts: str,
    col: str,
    bands: Mapping[str, tuple[int, int]],
    every: int = 3600,
    samples: int = 24,
    hop: int = 12,
    by: Sequence[str] = (),
) -> DataFrame:
    """Power of each window in bands of whole cycles a window (low included, high excluded).

    Further columns: ``power`` (mean square, that is all bands from 0), ``peak`` (the cycles, 0 left out, with most power, the
    fewest on ties; null for a single sample), ``centroid`` (mean cycles weighted by power, 0 left out; null without any) and
    ``entropy`` (of the shares of power, 0 left out, in nats; null without any). Windows with an empty slot are left out.
    """
    fields = [*bands, "power", "centroid", "entropy"]
    shape = ", ".join(f"`{f}` double" for f in fields) + ", peak int"

    @F.pandas_udf(shape)
    def spectrum(x: pd.Series) -> pd.DataFrame:
        p = powers(np.vstack(x.to_numpy()) if len(x) else np.zeros((0, samples)))
        out = {name: p[:, low:high].sum(axis=1) for name, (low, high) in bands.items()}
        wave = p[:, 1:]
        all_wave = wave.sum(axis=1)
        live = (all_wave > 0) & (wave.shape[1] > 0)
        share = wave / np.where(live, all_wave, 1.0)[:, None]
        logs = np.log(np.where(share > 0, share, 1.0))
        out["power"] = p.sum(axis=1)
        out["centroid"] = np.where(live, share @ np.arange(1, p.shape[1]), np.nan)
        out["entropy"] = np.where(live, -(share * logs).sum(axis=1), np.nan)
        peaks = wave.argmax(axis=1) + 1 if wave.shape[1] else np.full(len(p), 0)
        out["peak"] = pd.array(np.where(peaks > 0, peaks, 0), dtype="Int32")
        frame = pd.DataFrame(out)
        frame.loc[frame["peak"] == 0, "peak"] = pd.NA
        return frame

    made = windows(df, ts, col, every, samples, hop, by).withColumn("_s", spectrum("x"))
    def known(name: str):
        value = F.col("_s").getField(name)
        return F.when(~F.isnan(value), value) if name in ("centroid", "entropy") else value
    return made.select(*by, "window_start", *[known(f).alias(f) for f in fields], F.col("_s.peak").alias("peak"))
