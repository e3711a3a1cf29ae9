"""Distinct counts and quantiles from stored sketches, next to the exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import sketches
from statloom.queries.registry import query, table
from statloom.runtime import scratch

PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


def daily_sketches(spark, sf):
    """One written sketch table by ship day, for distinct keys and for price and quantity."""
    rows = table(spark, sf, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    made = sketches.sketch(rows, ["l_shipdate"], ["l_partkey", "l_suppkey", "l_returnflag"], ["l_extendedprice", "l_quantity"])
    return rows, sketches.store(made, f"{scratch(spark)}-sketches")


@query("""
WITH v AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, unnest([
    {'variable': 'l_partkey', 'value': l_partkey::VARCHAR}, {'variable': 'l_suppkey', 'value': l_suppkey::VARCHAR},
    {'variable': 'l_returnflag', 'value': l_returnflag}]) AS s FROM lineitem)
SELECT month, s.variable AS variable, count(s.value) AS n, count(DISTINCT s.value) AS exact, true AS within FROM v GROUP BY ALL
""")
def q_distinct_sketch(spark, sf):
    """Monthly distinct counts from the daily sketches: the exact count and whether the estimate is within the stated error."""
    rows, days = daily_sketches(spark, sf)
    month = F.trunc("l_shipdate", "month").alias("month")
    found = sketches.distinct_counts(sketches.merge(days, [month]), ["month"])
    names = ["l_partkey", "l_suppkey", "l_returnflag"]
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.count_distinct(c).alias("exact")) for c in names])
    exact = rows.groupBy(month).agg(cells.alias("cells")).select("month", F.inline("cells"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * sketches.distinct_error())
    return found.join(exact, ["month", "variable"]).select("month", "variable", "n", "exact", near.alias("within"))


@query(f"""
SELECT year(l_shipdate) AS year, variable, prob, count(value) AS n, min(value)::DOUBLE AS least, max(value)::DOUBLE AS most, true AS within
FROM (SELECT l_shipdate, 'l_extendedprice' AS variable, l_extendedprice AS value FROM lineitem
      UNION ALL SELECT l_shipdate, 'l_quantity', l_quantity FROM lineitem), (SELECT unnest({PROBS})::DOUBLE AS prob) GROUP BY ALL
""")
def q_quantile_sketch(spark, sf):
    """Yearly quantiles from the daily sketches: whether the exact rank of each estimate is within the stated error."""
    rows, days = daily_sketches(spark, sf)
    years = sketches.merge(days, [F.year("l_shipdate").alias("year")])
    found = sketches.quantiles(years, PROBS, ["year", "least", "most"])
    rows = rows.withColumn("year", F.year("l_shipdate"))
    one, two = (sketches.check_quantiles(rows, found.drop("least", "most"), ["year"], c) for c in ("l_extendedprice", "l_quantity"))
    ends = years.select("year", "variable", "least", "most")
    return one.unionByName(two).join(ends, ["year", "variable"]).select("year", "variable", "prob", "n", "least", "most", "within")
