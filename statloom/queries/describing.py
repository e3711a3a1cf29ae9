"""Statistics, frequency tables and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import charts, describe, frequency
from statloom.queries.registry import holed, holed_sql, long_sql, query, table
from statloom.sources.readers import inventory

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

BY_FLAG = long_sql("lineitem", MEASURES, ["l_returnflag"])
WHOLE = long_sql("lineitem", MEASURES)


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


@query(f"""
WITH long AS ({BY_FLAG}),
modes AS (
  SELECT l_returnflag, variable, value AS mode,
         row_number() OVER (PARTITION BY l_returnflag, variable ORDER BY count(*) DESC, value) AS rn
  FROM long GROUP BY l_returnflag, variable, value),
s AS (
  SELECT l_returnflag, variable, count(*) AS n, avg(value) AS mean, median(value) AS median, min(value) AS lo,
         max(value) AS hi, var_samp(value) AS variance, stddev_samp(value) AS std,
         quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75
  FROM long GROUP BY l_returnflag, variable)
SELECT s.l_returnflag, s.variable, n AS count, mean, median, m.mode, lo AS min, hi AS max, hi - lo AS range, variance, std,
       std / nullif(mean, 0) AS cv, p25, median AS p50, p75, p75 - p25 AS iqr
FROM s JOIN modes m ON m.l_returnflag = s.l_returnflag AND m.variable = s.variable AND m.rn = 1
""")
def q_describe(spark, sf):
    return describe.describe(lineitem(spark, sf), MEASURES, ["l_returnflag"])


@query("""
SELECT 'l_quantity' AS variable, l_quantity AS mode FROM lineitem GROUP BY l_quantity
ORDER BY count(*) DESC, l_quantity LIMIT 1
""")
def q_mode(spark, sf):
    return describe.mode_of(lineitem(spark, sf), ["l_quantity"])


@query("""
WITH c AS (SELECT p_size AS mode, count(*) AS count FROM part GROUP BY p_size)
SELECT mode, count FROM c WHERE count = (SELECT max(count) FROM c)
""")
def q_all_modes(spark, sf):
    return describe.all_modes(table(spark, sf, "part"), "p_size")


@query(f"""
SELECT l_returnflag, variable, count(*) AS n, skewness(value) AS skew, kurtosis(value) AS kurtosis
FROM ({BY_FLAG}) GROUP BY l_returnflag, variable
""")
def q_shape(spark, sf):
    return describe.shape(lineitem(spark, sf), MEASURES, ["l_returnflag"])


@query(f"""
WITH t AS (SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS target FROM orders),
long AS ({long_sql("t", ["o_totalprice", "o_custkey"], ["target"])}),
med AS (SELECT target, variable, median(value) AS m FROM long GROUP BY target, variable),
mad AS (SELECT target, variable, median(abs(value - m)) AS mad FROM long JOIN med USING (target, variable)
        GROUP BY target, variable),
s AS (SELECT target, variable, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
             var_samp(value) AS variance, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
             min(value) AS min, max(value) AS max, skewness(value) AS skew, kurtosis(value) AS kurtosis
      FROM long GROUP BY target, variable)
SELECT variable, target, CASE WHEN target = 1 THEN 'filled' ELSE 'open' END AS group_label, n, mean, median,
       mean - median AS mean_minus_median, std, variance, std / nullif(mean, 0) AS cv, iqr, mad, max - min AS range,
       min, max, skew, kurtosis
FROM s JOIN mad USING (target, variable)
""")
def q_group_stats(spark, sf):
    orders = table(spark, sf, "orders").withColumn("target", (F.col("o_orderstatus") == "F").cast("int"))
    return describe.group_describe(orders, ["o_totalprice", "o_custkey"], "target", {1: "filled", 0: "open"})


@query(f"""
WITH long AS ({BY_FLAG}), med AS (SELECT l_returnflag, variable, median(value) AS m FROM long GROUP BY ALL)
SELECT l_returnflag, variable, count(*) AS n, median(abs(value - m)) AS mad,
       1.4826::DOUBLE * median(abs(value - m)) AS robust_sigma
FROM long JOIN med USING (l_returnflag, variable) GROUP BY l_returnflag, variable
""")
def q_mad(spark, sf):
    return describe.median_abs_deviation(lineitem(spark, sf), MEASURES, ["l_returnflag"])


@query(f"""
WITH long AS ({BY_FLAG}), c AS (SELECT l_returnflag, variable, avg(value) AS m FROM long GROUP BY ALL)
SELECT l_returnflag, variable, avg(abs(value - m)) AS mean_abs_dev
FROM long JOIN c USING (l_returnflag, variable) GROUP BY l_returnflag, variable
""")
def q_mean_abs_dev(spark, sf):
    return describe.mean_abs_deviation(lineitem(spark, sf), MEASURES, ["l_returnflag"])


@query(f"""
WITH r AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i,
                  count(*) OVER (PARTITION BY variable) AS n FROM ({WHOLE}))
SELECT variable, count(*) AS kept, avg(value) AS trimmed_mean FROM r
WHERE i > floor(n * 0.1::DOUBLE) AND i <= n - floor(n * 0.1::DOUBLE) GROUP BY variable
""")
def q_trimmed_mean(spark, sf):
    return describe.trimmed_mean(lineitem(spark, sf), MEASURES, 0.1)


@query(f"""
SELECT variable, count(*) AS n, exp(avg(ln(value))) AS geometric_mean FROM ({WHOLE}) WHERE value > 0 GROUP BY variable
""")
def q_geometric_mean(spark, sf):
    return describe.geometric_mean(lineitem(spark, sf), MEASURES)


@query(f"""
WITH r AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i,
                  count(*) OVER (PARTITION BY variable) AS n FROM ({WHOLE})),
h AS (SELECT *, least(n, greatest(1, (n + 1) * prob)) AS h
      FROM r, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS prob)),
ab AS (SELECT variable, prob, max(h) AS h, max(CASE WHEN i = floor(h) THEN value END) AS a,
              max(CASE WHEN i = ceil(h) THEN value END) AS b FROM h GROUP BY variable, prob)
SELECT variable, prob, a + (b - a) * (h - floor(h)) AS value FROM ab
""")
def q_percentile_weibull(spark, sf):
    return describe.weibull_percentiles(lineitem(spark, sf), MEASURES, [0.1, 0.25, 0.5, 0.75, 0.9])


@query("""
WITH t AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
                  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, user_id FROM events),
c AS (SELECT 'value' AS variable, count(*) - count(value) AS missing_count, count(*) AS n FROM t
      UNION ALL SELECT 'event_type', count(*) - count(event_type), count(*) FROM t
      UNION ALL SELECT 'user_id', count(*) - count(user_id), count(*) FROM t)
SELECT variable, missing_count, missing_count * 100.0::DOUBLE / n AS missing_percent FROM c
""")
def q_missing_values(spark, sf):
    events = holed(table(spark, sf, "events"), {"value": 7, "event_type": 11}, "event_id")
    return describe.missing(events, ["value", "event_type", "user_id"])


@query("""
SELECT 'o_custkey' AS variable, count(DISTINCT o_custkey) AS distinct FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
""")
def q_distinct_counts(spark, sf):
    return describe.distinct_counts(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
WITH s AS (SELECT p_brand, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std, min(p_retailprice) AS min,
                  max(p_retailprice) AS max, quantile_cont(p_retailprice, 0.25) AS p25,
                  quantile_cont(p_retailprice, 0.75) AS p75 FROM part GROUP BY p_brand)
SELECT p_brand AS brand, *EXCLUDE (p_brand), max - min AS range, std * std AS variance, std / nullif(mean, 0) AS cv,
       p75 - p25 AS iqr FROM s
""")
def q_extend_summary(spark, sf):
    base = describe.describe(table(spark, sf, "part"), ["p_retailprice"], ["p_brand"], mode=False)
    stored = base.select("p_brand", "mean", "std", "min", "max", "p25", "p75")
    return describe.extend_summary(stored.withColumnsRenamed({"p_brand": "brand"}))


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM t" for a in MEASURES for b in MEASURES
    ).join(
        [f"WITH t AS ({holed_sql('lineitem', MEASURES[1:], {MEASURES[0]: 7}, 'l_orderkey')}) ", ""]
    )
)
def q_correlation(spark, sf):
    return describe.correlation(holed(lineitem(spark, sf), {"l_quantity": 7}, "l_orderkey"), MEASURES)


@query("""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT event_id, value, (value - m) / s AS z, CAST(abs((value - m) / s) > 3 AS INTEGER) AS is_outlier FROM events, s
""")
def q_zscore(spark, sf):
    return describe.zscore(table(spark, sf, "events").select("event_id", "value"), "value")


@query("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, 'value' AS variable, count(*) AS n,
       count(*) FILTER (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
FROM events JOIN q USING (event_type) GROUP BY event_type
""")
def q_outlier_counts(spark, sf):
    return describe.outlier_counts(table(spark, sf, "events"), ["value"], ["event_type"])


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS part, count(*) AS n,
       avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max
FROM lineitem GROUP BY ROLLUP (l_returnflag)
""")
def q_rollup_stats(spark, sf):
    part = F.when(F.grouping("l_returnflag") == 1, "all").otherwise(F.col("l_returnflag"))
    x = "l_quantity"
    table_ = lineitem(spark, sf).rollup("l_returnflag").agg(
        part.alias("part"),
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    return table_.drop("l_returnflag")


@query("""
SELECT event_type, count(*) AS absolute_frequency, count(*) / (SELECT count(*) FROM events)::DOUBLE AS relative_frequency
FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events) GROUP BY event_type
""")
def q_frequency(spark, sf):
    return frequency.frequency(holed(table(spark, sf, "events"), {"event_type": 7}, "event_id"), "event_type")


@query("""
SELECT p_size, count(*) AS absolute_frequency, count(*) / (SELECT count(*) FROM part)::DOUBLE AS relative_frequency
FROM part GROUP BY p_size ORDER BY p_size
""")
def q_frequency_sorted(spark, sf):
    return frequency.frequency(table(spark, sf, "part"), "p_size").orderBy("p_size")


@query("""
WITH n AS (SELECT count(*)::DOUBLE AS n FROM orders)
SELECT 'o_orderstatus' AS variable, o_orderstatus AS value, count(*) AS absolute_frequency,
       count(*) / max(n) AS relative_frequency FROM orders, n GROUP BY o_orderstatus
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*), count(*) / max(n) FROM orders, n GROUP BY o_orderpriority
""")
def q_frequency_many(spark, sf):
    return frequency.frequency_many(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
WITH t AS (SELECT event_type FROM events WHERE event_id % 7 <> 0)
SELECT event_type, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t) AS percent FROM t GROUP BY event_type
""")
def q_distribution_pct(spark, sf):
    return frequency.distribution(holed(table(spark, sf, "events"), {"event_type": 7}, "event_id"), "event_type")


@query("""
SELECT c_mktsegment, count(*) / sum(count(*)) OVER ()::DOUBLE AS share, 360.0::DOUBLE * count(*) / sum(count(*)) OVER ()::DOUBLE AS angle
FROM customer GROUP BY c_mktsegment
""")
def q_pie(spark, sf):
    return frequency.pie(table(spark, sf, "customer"), "c_mktsegment")


@query("""
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY l_returnflag
""")
def q_crosstab(spark, sf):
    rows = lineitem(spark, sf)
    return frequency.crosstab(rows, "l_returnflag", "l_linestatus")


@query("""
WITH c AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS status_F,
                  count(*) FILTER (l_linestatus = 'O') AS status_O FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, status_F, status_O, status_F + status_O AS total,
       status_F * 100.0::DOUBLE / (SELECT sum(status_F) FROM c)::DOUBLE AS status_F_pct_within_group,
       status_O * 100.0::DOUBLE / nullif((SELECT sum(status_O) FROM c), 0)::DOUBLE AS status_O_pct_within_group FROM c
""")
def q_crosstab_pct(spark, sf):
    return frequency.crosstab_percent(lineitem(spark, sf), "l_returnflag", "l_linestatus", prefix="status_")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderpriority, o_orderstatus")
def q_grouped_bars(spark, sf):
    return frequency.crosstab_long(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("""
SELECT o_orderpriority, avg(CAST(o_totalprice > 200000 AS INTEGER)) AS target_rate FROM orders GROUP BY o_orderpriority
""")
def q_target_rate(spark, sf):
    orders = table(spark, sf, "orders").withColumn("target", (F.col("o_totalprice") > 200000).cast("int"))
    return frequency.target_rate(orders, "o_orderpriority", "target")


@query("SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY count DESC, source LIMIT 15")
def q_topk(spark, sf):
    return frequency.top_categories(table(spark, sf, "documents"), "source", 15)


@query("""
WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 6)
SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_brand IN (FROM top)
""")
def q_topk_semi(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return frequency.keep_top(part, "p_brand", 6)


@query("""
WITH top AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 2),
t AS (SELECT CAST(p_type IN (FROM top) AS INTEGER) AS in_top, p_retailprice FROM part)
SELECT in_top, count(*) AS n, avg(p_retailprice) AS mean_price FROM t GROUP BY in_top
""")
def q_topk_vs_rest(spark, sf):
    marked = frequency.top_or_rest(table(spark, sf, "part"), "p_type", 2)
    return marked.groupBy("in_top").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price"))


@query("""
SELECT quality, count(*) AS n, (SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * count(*)) AS weight
FROM labels GROUP BY quality
""")
def q_class_weights(spark, sf):
    return frequency.class_weights(table(spark, sf, "labels"), "quality")


@query("SELECT md5(text) AS row_md5, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def q_duplicate_rows(spark, sf):
    return frequency.duplicate_rows(table(spark, sf, "documents"), ["text"])


@query("""
SELECT 'l_quantity' AS variable, count(*) FILTER (l_quantity < 2 OR l_quantity > 49) AS violations FROM lineitem
UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount < 0.0::DOUBLE OR l_discount > 0.08::DOUBLE) FROM lineitem
UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0 OR l_tax > 1) FROM lineitem
""")
def q_domain_violations(spark, sf):
    allowed = {"l_quantity": (2, 49), "l_discount": (0.0, 0.08), "l_tax": (0, 1)}
    return frequency.domain_violations(lineitem(spark, sf), allowed)


def box_sql(long: str, keys: str) -> str:
    return f"""
WITH long AS ({long}),
q AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3
      FROM long GROUP BY {keys})
SELECT {keys}, count(*) AS count, min(value) AS min, q1, median, q3, max(value) AS max, avg(value) AS mean,
       min(value) FILTER (value >= q1 - 1.5::DOUBLE * (q3 - q1)) AS whisker_low,
       max(value) FILTER (value <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high,
       count(*) FILTER (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS fliers
FROM long JOIN q USING ({keys}) GROUP BY {keys}, q1, median, q3
"""


@query(box_sql(long_sql("events", ["value"], ["event_type"]), "event_type, variable"))
def q_box_stats(spark, sf):
    return charts.box_stats(table(spark, sf, "events"), ["value"], ["event_type"])


@query(box_sql(long_sql("lineitem", MEASURES, ["l_returnflag"]), "l_returnflag, variable"))
def q_box_stats_long(spark, sf):
    return charts.box_stats(lineitem(spark, sf), MEASURES, ["l_returnflag"])


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t})) AS columns"
        for t in TABLES
    )
)
def q_inventory(spark, sf):
    return inventory({t: table(spark, sf, t) for t in TABLES})
