"""Fourier features of windows."""

from __future__ import annotations

from statloom.operators import spectrum
from statloom.queries.registry import query, table

BANDS = {"level": (0, 1), "daily": (1, 2), "slow": (2, 5), "fast": (5, 13)}
BAND_SQL = ", ".join(f"sum(p) FILTER (k >= {low} AND k < {high}) AS {name}" for name, (low, high) in BANDS.items())


@query(f"""
WITH h AS (SELECT event_type, floor(epoch_us(ts) / 3600000000::DOUBLE)::BIGINT AS slot, avg(value) AS v FROM events GROUP BY ALL),
w AS (SELECT event_type, unnest(range(ceil((slot - 23) / 12::DOUBLE)::BIGINT, floor(slot / 12::DOUBLE)::BIGINT + 1)) AS w, slot, v FROM h),
x AS (SELECT event_type, w, slot - w * 12 AS j, v, count(*) OVER (PARTITION BY event_type, w) AS c FROM w QUALIFY c = 24),
f AS (SELECT event_type, w, k, sum(v * cos(2 * pi() * k * j / 24)) / 24 AS re, sum(v * sin(2 * pi() * k * j / 24)) / 24 AS im
      FROM x, range(13) r(k) GROUP BY ALL),
p AS (SELECT event_type, w, k, (re * re + im * im) * CASE WHEN k IN (0, 12) THEN 1 ELSE 2 END AS p FROM f),
s AS (SELECT *, p / sum(p) FILTER (k > 0) OVER (PARTITION BY event_type, w) AS share FROM p)
SELECT event_type, TIMESTAMP '1970-01-01' + to_hours(w * 12) AS window_start, {BAND_SQL}, sum(p) AS power,
       sum(k * share) FILTER (k > 0) AS centroid, -sum(share * ln(share)) FILTER (k > 0) AS entropy,
       (arg_max(k, p) FILTER (k > 0))::INTEGER AS peak
FROM s GROUP BY event_type, w
""")
def q_band_powers(spark, sf):
    return spectrum.band_powers(table(spark, sf, "events"), "ts", "value", BANDS, by=["event_type"])
