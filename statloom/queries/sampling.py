"""Exact samples and splits in hash order."""

from __future__ import annotations

from statloom.operators import sampling
from statloom.queries.registry import query, table

ORDER = "md5({key}::VARCHAR || '|42'), {key}"


@query(f"SELECT event_id, event_type, value FROM events ORDER BY {ORDER.format(key='event_id')} LIMIT 1000")
def q_sample_exact(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return sampling.sample_exact(rows, "event_id", 1000)


@query(f"""
SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {ORDER.format(key='event_id')}) <= 800
""")
def q_cap_per_class(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return sampling.cap_per_class(rows, "event_id", "event_type", 800)


@query(f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS c, count(*) OVER () AS n,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER.format(key='o_orderkey')}) AS i FROM orders)
SELECT o_orderkey, o_orderstatus FROM r WHERE i <= round(c * (2000 / n::DOUBLE))
""")
def q_stratified_sample(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_sample(rows, "o_orderkey", "o_orderstatus", 2000)


@query(f"""
WITH r AS (SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS c,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER.format(key='o_orderkey')}) AS i FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN i <= ceil(c * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r
""")
def q_stratified_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_split(rows, "o_orderkey", "o_orderstatus", 0.8)
