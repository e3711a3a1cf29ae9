"""Sources, sinks, type coercion and joins of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.scalars import first_prefix, flag, half_even, recode, to_number, to_time
from statloom.operators.frequency import frequency, label_lookup
from statloom.queries.registry import query, table
from statloom.runtime import lookup, scratch
from statloom.sources import positions, readers, sinks

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("SELECT * FROM part")
def q_csv_roundtrip(spark, sf):
    path = scratch(spark)
    sinks.write_csv(table(spark, sf, "part"), path)
    return readers.read_csv(spark, path, PART)


@query("""
SELECT event_id::DOUBLE AS event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, NULL::DOUBLE AS word FROM events
""")
def q_read_headerless(spark, sf):
    path = scratch(spark)
    mark = F.when(F.col("event_id") % 7 == 0, "?").otherwise(F.col("value").cast("string"))
    table(spark, sf, "events").select("event_id", mark, "event_type").write.csv(path)
    return readers.read_headerless(spark, path, ["event_id", "value", "word"])


@query("SELECT event_id::DOUBLE AS event_id, value, user_id::DOUBLE AS user_id FROM events")
def q_read_blank_separated(spark, sf):
    path = scratch(spark)
    line = F.concat(F.lit("\t  "), "event_id", F.lit("   "), "value", F.lit("\t "), "user_id", F.lit(" "))
    table(spark, sf, "events").select(line).write.text(path)
    rows = readers.read_blank_separated(spark, path, ["event_id", "value", "user_id"])
    return rows.drop("file", "_block", "_line")


@query("""
SELECT doc_id::INTEGER AS newid, 'A & B <' || source || '>' AS title, lang || ' ' || n_chars AS body, [lang, source] AS topics FROM documents
""")
def q_read_tagged(spark, sf):
    path = scratch(spark)
    record = F.concat(
        F.lit('<RECORD KIND="x" NEWID="'), "doc_id", F.lit('"><TOPICS><D>'), "lang", F.lit("</D><D>"), "source",
        F.lit("</D></TOPICS>\n<TITLE>A &amp; B\n &lt;"), "source", F.lit("&gt;</TITLE><BODY>"), "lang",
        F.lit("<b>  \n"), "n_chars", F.lit("</b></BODY></RECORD>"),
    )
    table(spark, sf, "documents").select(record).write.text(path)
    return readers.read_tagged(spark, path, "RECORD", "NEWID", ["TITLE", "BODY"], ["TOPICS"])


def tagged(col):
    """Escaped text for a latin-1 file: markup by name, characters beyond latin-1 by number."""
    named = F.coalesce(col, F.lit(""))
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        named = F.replace(named, F.lit(char), F.lit(code))
    numbered = F.transform(F.split(named, ""), lambda c: F.when(F.ascii(c) > 255, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
    return F.when(named.rlike(r"[^\x00-\xFF]"), F.array_join(numbered, "")).otherwise(named)


@query("""
SELECT doc_id::INTEGER AS newid, trim(regexp_replace(coalesce(source, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS title,
       trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS body, [lang, source] AS topics FROM documents
""")
def q_read_tagged_text(spark, sf):
    path = scratch(spark)
    record = F.concat(
        F.lit('<RECORD KIND="x" NEWID="'), "doc_id", F.lit('"><TOPICS><D>'), "lang", F.lit("</D><D>"), "source",
        F.lit("</D></TOPICS>\n<TITLE>"), tagged(F.col("source")), F.lit("</TITLE><BODY>"), tagged(F.col("text")), F.lit("</BODY></RECORD>"),
    )
    table(spark, sf, "documents").select(F.encode(record, "ISO-8859-1").cast("string")).write.text(path)
    return readers.read_tagged(spark, path, "RECORD", "NEWID", ["TITLE", "BODY"], ["TOPICS"])


@query("SELECT p_partkey, regexp_split_to_array(trim(p_name), '\\s+') AS tokens, len(regexp_split_to_array(trim(p_name), '\\s+'))::INTEGER AS n FROM part")
def q_split_whitespace(spark, sf):
    tokens = readers.split_blanks(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", tokens.alias("tokens"), F.size(tokens).alias("n"))


@query("""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section
FROM pages
""")
def q_source_from_path(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        readers.name_part(url, "^https?://([^/]+)").alias("host"),
        readers.name_part(url, "^https?://[^/]+/([^/?#]*)").alias("section"),
    )


def unescape_sql(expr: str) -> str:
    """The references that the pages hold, written apart from the operator; the one for & last, so that what it gives is not read again."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("#39", "''"), ("amp", "&")):
        expr = f"regexp_replace({expr}, '&{name};?', '{char}', 'g')"
    return expr


def squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
TITLE = "regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"


@query(f"""
SELECT page_id, {squeeze_sql(unescape_sql(squeeze_sql(TITLE)))} AS title, length({squeeze_sql(unescape_sql(BARE))})::INTEGER AS text_chars,
       len(regexp_extract_all(html, '(?i)<a\\s'))::INTEGER AS links FROM pages
""")
def q_html_extract(spark, sf):
    return readers.html_features(table(spark, sf, "pages"), "page_id", "html")


@query("SELECT doc_id, regexp_replace(text, '[^\\x{0000}-\\x{00FF}]', '?', 'g') AS text FROM documents")
def q_decode_latin1(spark, sf):
    raw = F.encode("text", "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", readers.latin1(raw).alias("text"))


@query("""
SELECT vec_id, list_sum(x) / len(x) AS mean_value,
       sqrt(greatest(list_sum(list_transform(x, lambda v: (v - list_sum(x) / len(x)) ** 2)) / len(x), 0)) AS std_value,
       list_min(x) AS min_value, list_max(x) AS max_value
FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
""")
def q_array_features(spark, sf):
    return readers.array_features(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("""
SELECT p_type, CASE WHEN starts_with(p_type, 'ECO') THEN 'ECO' WHEN starts_with(p_type, 'S') THEN 'S'
       WHEN starts_with(p_type, 'STANDARD') THEN 'STANDARD' ELSE 'general' END AS scope, count(*) AS n FROM part GROUP BY ALL
""")
def q_prefix_classify(spark, sf):
    scope = first_prefix(F.col("p_type"), ["ECO", "S", "STANDARD"])
    return table(spark, sf, "part").groupBy("p_type", scope.alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'status' AS dataset, count(DISTINCT o_orderstatus) AS rows, 3 AS columns FROM orders
UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment), 3 FROM customer
""")
def q_result_bundle(spark, sf):
    frames = {
        "status": frequency(table(spark, sf, "orders"), "o_orderstatus"),
        "segments": frequency(table(spark, sf, "customer"), "c_mktsegment"),
    }
    paths = sinks.write_bundle(frames, scratch(spark))
    return readers.inventory(sinks.read_bundle(spark, paths))


@query("""
SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL::DOUBLE AS letters,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events
""")
def q_type_coercion(spark, sf):
    marked = F.when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select(
        "event_id",
        to_number(F.get_json_object("props", "$.k")).alias("k"),
        to_number(F.col("event_type")).alias("letters"),
        to_number(marked).alias("value"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS parsed FROM orders
""")
def q_timestamp_parse(spark, sf):
    written = F.when(F.col("o_orderkey") % 7 == 0, "not a time").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-ddHH:mm:ss")
    )
    parsed = to_time(written, "yyyy-MM-ddHH:mm:ss").cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", parsed.alias("parsed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS target FROM orders
""")
def q_binary_target(spark, sf):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", flag(price > 200000).alias("target"))


@query("""
SELECT label, count(*) AS n FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS label FROM lineitem)
GROUP BY label
""")
def q_map_codes(spark, sf):
    label = recode(F.col("l_returnflag"), {"A": "accepted", "R": "returned"})
    return table(spark, sf, "lineitem").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_label_lookup_left(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return label_lookup(docs, table(spark, sf, "labels"), "doc_id")


@query("SELECT l.doc_id, l.quality, d.n_chars, length(d.text)::INTEGER AS text_chars FROM labels l JOIN documents d USING (doc_id)")
def q_join_features(spark, sf):
    features = table(spark, sf, "documents").select("doc_id", "n_chars", F.char_length("text").alias("text_chars"))
    return readers.join_on_stem(table(spark, sf, "labels").select("doc_id", "quality"), features, "doc_id")


@query("SELECT o_orderkey, c_custkey AS custkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def q_bind_by_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_totalprice")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    return lookup(orders, customers, ["custkey"], spread=["o_orderkey"])


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_custkey, c_acctbal, c_mktsegment FROM customer")
def q_bind_by_position(spark, sf):
    """Two tables written apart, in different numbers of files and without a common key, side by side by row position."""
    rows, folder = table(spark, sf, "customer"), scratch(spark)
    positions.write_parts(rows.select("c_custkey"), f"{folder}/keys", ["c_custkey"], 5)
    more = rows.repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select("c_acctbal", "c_mktsegment")
    more.write.csv(f"{folder}/values")
    left = positions.read_numbered(spark, f"{folder}/keys", "c_custkey long")
    return positions.bind(left, positions.read_numbered(spark, f"{folder}/values", "c_acctbal double, c_mktsegment string"))


@query("SELECT l_returnflag, round_even(count(*) / 8, 2) AS eighths, round_even(count(*) / 4 + 0.125, 1) AS quarters, round_even(count(*) / 2, 0) AS halves FROM lineitem GROUP BY ALL")
def q_rounded(spark, sf):
    """Counts as eighths, quarters and halves, rounded half to even."""
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("double").alias("n"))
    parts = {"eighths": (F.col("n") / 8, 2), "quarters": (F.col("n") / 4 + 0.125, 1), "halves": (F.col("n") / 2, 0)}
    return counts.select("l_returnflag", *[half_even(c, d).alias(name) for name, (c, d) in parts.items()])
