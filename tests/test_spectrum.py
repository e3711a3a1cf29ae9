"""Fourier features: brute-force transforms, energy kept, gaps, constant series, empty tables."""

import math

import numpy as np
import pandas as pd
import pytest

from statloom.operators import spectrum

BANDS = {"low": (0, 2), "high": (2, 99)}


@pytest.mark.parametrize("n", [1, 2, 7, 24])
def test_power_is_mean_square(n):
    x = np.random.default_rng(n).normal(size=(50, n))
    p = spectrum.powers(x)
    assert p.shape == (50, n // 2 + 1) and np.allclose(p.sum(axis=1), (x * x).mean(axis=1))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [("wave", t, 5 + 2 * math.sin(2 * math.pi * 3 * (t % 10) / 10)) for t in range(-20, 60)]
    rows += [("noise", t, float(rng.normal())) for t in range(95) if t != 42]
    rows += [("noise", 7, 3.0)]  # a second value in a slot
    rows += [("flat", t, 0.0) for t in range(10)] + [(None, t, float(t)) for t in range(10)] + [("noise", None, 1.0), ("noise", 96, None)]
    schema = "g string, s int, y double"
    df = spark.createDataFrame(rows, schema).selectExpr("g", "timestamp_seconds(s * 60L + 5) AS ts", "y", "1 AS window_start_", "1 AS x")
    return pd.DataFrame(rows, columns=["g", "s", "y"]), df.repartition(4)


def brute(pdf, samples, hop):
    out = {}
    for g, part in pdf.dropna(subset=["s", "y"]).groupby("g", dropna=False):
        at = part.groupby("s")["y"].mean()
        for w in range(-30, 100):
            slots = range(w * hop, w * hop + samples)
            if all(s in at.index for s in slots):
                x = [at[s] for s in slots]
                p = []
                for k in range(samples // 2 + 1):
                    re = sum(v * math.cos(2 * math.pi * k * j / samples) for j, v in enumerate(x)) / samples
                    im = sum(v * math.sin(2 * math.pi * k * j / samples) for j, v in enumerate(x)) / samples
                    p.append((re * re + im * im) * (1 if k in (0, samples / 2) else 2))
                out[(None if pd.isna(g) else g, w * hop * 60)] = p
    return out


@pytest.mark.parametrize("hop", [3, 10, 15])
def test_same_as_plain_transform(table, hop):
    pdf, df = table
    got = spectrum.band_powers(df, "ts", "y", BANDS, 60, 10, hop, ["g"]).collect()
    want = brute(pdf, 10, hop)
    epoch = pd.Timestamp("1970-01-01")
    assert {(r["g"], (pd.Timestamp(r["window_start"]) - epoch).total_seconds()) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        p = want[(r["g"], (pd.Timestamp(r["window_start"]) - epoch).total_seconds())]
        assert [r["low"], r["high"], r["power"]] == pytest.approx([sum(p[:2]), sum(p[2:]), sum(p)], abs=1e-12)
        if r["g"] == "flat":
            assert r["centroid"] is None and r["entropy"] is None
            continue
        share = np.array(p[1:]) / sum(p[1:])
        assert r["centroid"] == pytest.approx(share @ np.arange(1, 6))
        assert r["entropy"] == pytest.approx(-sum(s * math.log(s) for s in share if s > 1e-30), abs=1e-9)
        assert r["peak"] == int(np.argmax(p[1:])) + 1
    assert {r["peak"] for r in got if r["g"] == "wave"} == {3}


def test_single_samples_and_empty(table):
    _, df = table
    one = spectrum.band_powers(df, "ts", "y", BANDS, 60, 1, 1).collect()
    assert one and all(r["peak"] is None and r["centroid"] is None for r in one)
    assert spectrum.band_powers(df.limit(0), "ts", "y", BANDS, by=["g"]).count() == 0
