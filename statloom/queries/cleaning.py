"""Imputation, clipping, scaling, encoding and the comparison of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.scalars import clip
from statloom.operators import cleaning, describe
from statloom.plans.catalog import Dataset, variable_types
from statloom.queries.registry import holed, holed_sql, long_sql, query, table

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEEP = ["l_orderkey", "l_linenumber", "l_returnflag"]
HOLES = {"l_quantity": 7, "l_extendedprice": 11}
SCALE = 3.0  # stretches every third price, so that the fences have something to cut

RAW_SQL = f"""
SELECT {", ".join(KEEP)}, l_discount, l_tax, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN l_extendedprice * {SCALE}::DOUBLE
            ELSE l_extendedprice END AS l_extendedprice FROM lineitem
"""
CLEAN_SQL = f"""
raw AS ({RAW_SQL}),
med AS (SELECT median(l_quantity) AS mq, median(l_extendedprice) AS mp FROM raw),
filled AS (SELECT * REPLACE (coalesce(l_quantity, mq) AS l_quantity, coalesce(l_extendedprice, mp) AS l_extendedprice)
           FROM raw, med),
f AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in COLS)} FROM filled),
cleaned AS (SELECT {", ".join(KEEP)}, {", ".join(
    f"CASE WHEN {c}_3 > {c}_1 THEN greatest({c}_1 - 1.5::DOUBLE * ({c}_3 - {c}_1), "
    f"least({c}_3 + 1.5::DOUBLE * ({c}_3 - {c}_1), {c})) ELSE {c} END AS {c}" for c in COLS)} FROM filled, f)
"""


def raw_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem").select(*KEEP, "l_partkey", *COLS)
    price = F.when(F.col("l_partkey") % 3 == 0, F.col("l_extendedprice") * SCALE).otherwise(F.col("l_extendedprice"))
    return holed(rows.withColumn("l_extendedprice", price), HOLES, "l_orderkey").drop("l_partkey")


@query(f"""
WITH t AS ({holed_sql("events", ["event_id"], {"value": 7}, "event_id")})
SELECT event_id, coalesce(value, (SELECT median(value) FROM t)) AS value FROM t
""")
def q_impute_median(spark, sf):
    events = holed(table(spark, sf, "events").select("event_id", "value"), {"value": 7}, "event_id")
    return cleaning.impute_median(events, ["value"])


@query(f"""
WITH t AS ({holed_sql("events", ["event_id"], {"value": 7}, "event_id")})
SELECT event_id, coalesce(value, (SELECT avg(value) FROM t)) AS value FROM t
""")
def q_impute_mean(spark, sf):
    events = holed(table(spark, sf, "events").select("event_id", "value"), {"value": 7}, "event_id")
    return cleaning.impute_mean(events, ["value"])


@query(f"""
WITH t AS ({holed_sql("events", ["event_id"], {"event_type": 7}, "event_id")}),
m AS (SELECT event_type FROM t WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, coalesce(event_type, (FROM m), 'unknown') AS event_type, 'unknown' AS empty FROM t
""")
def q_impute_mode(spark, sf):
    events = holed(table(spark, sf, "events").select("event_id", "event_type"), {"event_type": 7}, "event_id")
    events = events.withColumn("empty", F.lit(None).cast("string"))
    return cleaning.impute_mode(events, ["event_type", "empty"])


@query(f"""
WITH t AS ({holed_sql("orders", ["o_orderkey"], {"o_totalprice": 7, "o_orderpriority": 5, "o_orderstatus": 3}, "o_orderkey")}),
m AS (SELECT o_orderpriority FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM t)) AS o_totalprice,
       coalesce(o_orderpriority, (FROM m)) AS o_orderpriority, o_orderstatus FROM t
""")
def q_impute_auto(spark, sf):
    cols = {"o_totalprice": 7, "o_orderpriority": 5, "o_orderstatus": 3}
    orders = holed(table(spark, sf, "orders").select("o_orderkey", *cols), cols, "o_orderkey")
    return cleaning.impute_auto(orders, skip=["o_orderkey", "o_orderstatus"])


@query(f"""
WITH raw AS ({RAW_SQL}),
f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3,
             quantile_cont(l_quantity, 0.25) AS r1, quantile_cont(l_quantity, 0.75) AS r3 FROM raw)
SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice IS NOT NULL THEN
         greatest(q1 - 1.5::DOUBLE * (q3 - q1), least(q3 + 1.5::DOUBLE * (q3 - q1), l_extendedprice)) END AS l_extendedprice,
       CASE WHEN l_quantity IS NOT NULL THEN
         greatest(r1 - 1.5::DOUBLE * (r3 - r1), least(r3 + 1.5::DOUBLE * (r3 - r1), l_quantity)) END AS l_quantity FROM raw, f
""")
def q_iqr_clip(spark, sf):
    rows = raw_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return cleaning.iqr_clip(rows, ["l_extendedprice", "l_quantity"])


@query(f"""
WITH raw AS ({RAW_SQL}),
f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3,
             quantile_cont(l_quantity, 0.25) AS r1, quantile_cont(l_quantity, 0.75) AS r3 FROM raw)
SELECT 'l_extendedprice' AS variable, avg(CAST(coalesce(l_extendedprice < q1 - 1.5::DOUBLE * (q3 - q1)
       OR l_extendedprice > q3 + 1.5::DOUBLE * (q3 - q1), false) AS INTEGER)) AS clipped_fraction FROM raw, f
UNION ALL
SELECT 'l_quantity', avg(CAST(coalesce(l_quantity < r1 - 1.5::DOUBLE * (r3 - r1)
       OR l_quantity > r3 + 1.5::DOUBLE * (r3 - r1), false) AS INTEGER)) FROM raw, f
""")
def q_clipped_share(spark, sf):
    rows = raw_lineitem(spark, sf)
    return cleaning.clipped_share(rows, cleaning.clip_limits(rows, ["l_extendedprice", "l_quantity"]))


@query("SELECT doc_id, least(n_chars, 1000)::DOUBLE AS n_chars FROM documents")
def q_fixed_clip(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", clip(F.col("n_chars").cast("double"), high=F.lit(1000.0)).alias("n_chars"))


@query(f"WITH {CLEAN_SQL} SELECT * FROM cleaned")
def q_clean_steps(spark, sf):
    rows = raw_lineitem(spark, sf)
    filled = cleaning.impute_median(rows, COLS)
    return cleaning.iqr_clip(filled, COLS)


STATE = "{c} AS value, '{c}' AS variable"


def state_sql(source: str) -> str:
    return (
        f"SELECT variable, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.75) - "
        f"quantile_cont(value, 0.25) AS iqr, min(value) AS min, max(value) AS max FROM ({long_sql(source, COLS)}) GROUP BY variable"
    )


@query(f"""
WITH {CLEAN_SQL}, a AS ({state_sql("raw")}), b AS ({state_sql("cleaned")})
SELECT variable, {", ".join(f"a.{m} AS {m}_raw, b.{m} AS {m}_cleaned" for m in ("mean", "std", "iqr", "min", "max"))}
FROM a JOIN b USING (variable)
""")
def q_raw_vs_cleaned(spark, sf):
    return cleaning.compare_cleaned(raw_lineitem(spark, sf), COLS)


@query(f"""
WITH {CLEAN_SQL},
both_states AS (SELECT 'raw' AS state, variable, value FROM ({long_sql("raw", COLS)})
         UNION ALL SELECT 'cleaned', variable, value FROM ({long_sql("cleaned", COLS)})),
m AS (SELECT state, variable, value AS mode, row_number() OVER (PARTITION BY state, variable ORDER BY count(*) DESC, value) AS rn
      FROM both_states GROUP BY state, variable, value)
SELECT state, variable, count(*) AS count, avg(value) AS mean, median(value) AS median, any_value(m.mode) AS mode,
       min(value) AS min, max(value) AS max, max(value) - min(value) AS range, var_samp(value) AS variance,
       stddev_samp(value) AS std, stddev_samp(value) / nullif(avg(value), 0) AS cv, quantile_cont(value, 0.25) AS p25,
       median(value) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
FROM both_states JOIN m USING (state, variable) WHERE m.rn = 1 GROUP BY state, variable
""")
def q_stack_states(spark, sf):
    return cleaning.cleaned_states(raw_lineitem(spark, sf), COLS)


@query("SELECT event_id, ln(1 + value) AS value_log1p FROM events")
def q_log1p(spark, sf):
    return cleaning.log1p(table(spark, sf, "events"), ["value"]).select("event_id", "value_log1p")


@query("""
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, (value - lo) / (hi - lo) AS value_scaled FROM events, s
""")
def q_minmax(spark, sf):
    return cleaning.min_max(table(spark, sf, "events"), ["value"]).select("event_id", "value_scaled")


@query("""
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT event_id, (value - m) / s AS value_std FROM events, s
""")
def q_standardize(spark, sf):
    return cleaning.standardize(table(spark, sf, "events"), ["value"]).select("event_id", "value_std")


@query("""
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "c_mktsegment_BUILDING",
       CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS "c_mktsegment_MACHINERY",
       CAST(c_mktsegment = 'never seen' AS INTEGER) AS "c_mktsegment_never seen" FROM customer
""")
def q_one_hot(spark, sf):
    known = ["BUILDING", "MACHINERY", "never seen"]
    hot = cleaning.one_hot(table(spark, sf, "customer"), "c_mktsegment", known)
    return hot.select("c_custkey", *[f"c_mktsegment_{v}" for v in known])


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE
       dense_rank() OVER (PARTITION BY p_partkey % 7 = 0 ORDER BY p_brand) - 1 END AS p_brand_code FROM part
""")
def q_category_codes(spark, sf):
    part = holed(table(spark, sf, "part").select("p_partkey", "p_brand"), {"p_brand": 7}, "p_partkey")
    return cleaning.encode(part, "p_brand").select("p_partkey", "p_brand_code")


@query("""
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic),
t AS (SELECT toxic, greatest(1, round((SELECT max(n) FROM c) / n::DOUBLE))::INTEGER AS times FROM c)
SELECT doc_id, toxic, unnest(range(1, times + 1))::INTEGER AS copy FROM labels JOIN t USING (toxic)
""")
def q_oversample(spark, sf):
    return cleaning.oversample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic")


@query("""
SELECT 'lineitem' AS dataset, column_name AS variable,
       CASE WHEN column_name = 'l_returnflag' THEN 'target' WHEN column_name = 'l_shipdate' THEN 'datetime'
            WHEN column_name = 'l_linestatus' THEN 'qualitative' WHEN column_type = 'VARCHAR' THEN 'qualitative'
            ELSE 'quantitative_continuous_or_ordinal' END AS type,
       CASE WHEN column_name = 'l_returnflag' THEN 'target' WHEN column_name = 'l_shipdate' THEN 'time_index' ELSE 'feature' END AS role,
       NULL::VARCHAR AS description, column_name IN ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') AS selected
FROM (DESCRIBE lineitem)
""")
def q_variable_types(spark, sf):
    data = Dataset("lineitem", "l_returnflag", COLS, ["l_linestatus"], time="l_shipdate")
    return variable_types(table(spark, sf, "lineitem"), data)


@query(f"""
SELECT l_orderkey, l_linenumber, variable, value FROM (
  SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)
""")
def q_melt(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "variable", "value")


@query("""
SELECT 'supplier' AS party, s_suppkey AS id, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer
""")
def q_union_missing_cols(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("party"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")
    )
    customers = table(spark, sf, "customer").select(
        F.lit("customer").alias("party"),
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return describe.stack([suppliers, customers], fill_missing=True)


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM events)
SELECT * FROM t WHERE value IS NOT NULL AND event_type IS NOT NULL
""")
def q_dropna_subset(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    return holed(events, {"value": 7, "event_type": 5}, "event_id").dropna(subset=["value", "event_type"])
