"""Nearest neighbours and synthetic rows of a minority class."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.learning import neighbours
from statloom.queries.registry import query, table
from statloom.runtime import fixed

FEATURES = ["price", "quantity", "day"]

ORDERS = """
q AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_totalprice AS price, quantity, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS day,
             o_orderpriority = '1-URGENT' AS minor FROM orders JOIN q ON l_orderkey = o_orderkey),
s AS (SELECT stddev_pop(price) AS s1, stddev_pop(quantity) AS s2, stddev_pop(day) AS s3, count(*) AS n, count(*) FILTER (minor) AS m FROM o),
z AS (SELECT o_orderkey AS k, price / s1 AS a, quantity / s2 AS b, day / s3 AS c, s1, s2, s3 FROM o, s WHERE minor),
d AS (SELECT x.k AS k, y.k AS near, (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) AS far
      FROM z x JOIN z y ON x.k <> y.k),
nn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY far, near) AS rank FROM d QUALIFY rank <= 5)"""


def orders(spark, sf):
    """Price, total quantity and day of each order, and whether it is urgent."""
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    held = table(spark, sf, "orders").join(items, "o_orderkey")
    return held.select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        "quantity",
        F.unix_date(F.to_date("o_orderdate")).cast("double").alias("day"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )


@query(f"""
WITH {ORDERS}, r AS (SELECT k, row_number() OVER (ORDER BY md5(k::VARCHAR || '|42'), k) AS i FROM z),
t AS (SELECT k, (n - 2 * m) // m + CASE WHEN i <= (n - 2 * m) % m THEN 1 ELSE 0 END AS times FROM r, s),
c AS (SELECT k, unnest(range(1, times + 1))::INTEGER AS copy FROM t),
h AS (SELECT k, copy, md5(k::VARCHAR || '|42|' || copy::VARCHAR) AS h FROM c),
g AS (SELECT h.k, copy, near, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296::DOUBLE AS gap FROM h
      JOIN nn ON nn.k = h.k AND rank = ('0x' || substr(h, 1, 8))::BIGINT % 5 + 1)
SELECT g.k AS o_orderkey, copy, near AS neighbour, gap, (x.a + gap * (y.a - x.a)) * x.s1 AS price,
       (x.b + gap * (y.b - x.b)) * x.s2 AS quantity, (x.c + gap * (y.c - x.c)) * x.s3 AS day
FROM g JOIN z x ON x.k = g.k JOIN z y ON y.k = g.near
""")
def q_synthetic_minority(spark, sf):
    return neighbours.synthetic_minority(orders(spark, sf), "o_orderkey", FEATURES, F.col("urgent"))


@query(f"WITH {ORDERS} SELECT k AS o_orderkey, rank::INTEGER AS rank, near AS neighbour, sqrt(far) AS distance FROM nn")
def q_nearest_neighbours(spark, sf):
    rows = fixed(orders(spark, sf))
    scale = rows.agg(*[F.stddev_pop(c).alias(c) for c in FEATURES]).first()
    rows = rows.where("urgent").select("o_orderkey", *[(F.col(c) / (scale[c] or 1.0)).alias(c) for c in FEATURES])
    near = neighbours.nearest(rows, "o_orderkey", FEATURES)
    listed = near.select("o_orderkey", F.posexplode("neighbours").alias("rank", "e"))
    return listed.select("o_orderkey", (F.col("rank") + 1).alias("rank"), F.col("e.near").alias("neighbour"), F.sqrt("e.far").alias("distance"))
