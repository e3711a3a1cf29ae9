"""Document features and word statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions.scalars import WORD, slug
from statloom.operators import text
from statloom.queries.registry import query, table

WORDS = f"regexp_extract_all(lower(text), '{WORD}')"
STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY doc_id, term"


def documents(spark, sf):
    return table(spark, sf, "documents")


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '{WORD}'))::INTEGER AS word_count, length(text)::INTEGER AS char_count
FROM documents WHERE len(regexp_extract_all(text, '{WORD}')) > 0
""")
def q_text_features(spark, sf):
    return text.text_features(documents(spark, sf), "doc_id", "text")


@query(f"""
WITH t AS (SELECT doc_id, string_split(source || ' ' || lang, ' ') AS topics, trim(concat_ws(' ', source, text)) AS joined FROM documents)
SELECT doc_id, array_to_string(topics, ';') AS topics, coalesce(topics[1], 'NO_TOPIC') AS primary_topic,
       len(regexp_extract_all(joined, '{WORD}'))::INTEGER AS word_count, length(joined)::INTEGER AS char_count FROM t
""")
def q_document_features(spark, sf):
    docs = documents(spark, sf).withColumn("labels", F.split(F.concat("source", F.lit(" "), "lang"), " "))
    return text.document_features(docs, "doc_id", ["source", "text"], "labels")


@query("""
SELECT label, count(*) AS count FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_type || ' ' || p_name, ' '))) AS label FROM part)
GROUP BY label
""")
def q_multilabel(spark, sf):
    part = table(spark, sf, "part").withColumn("labels", F.split(F.concat("p_type", F.lit(" "), "p_name"), " "))
    return text.label_counts(part, "labels")


@query(f"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '{WORD}')))::INTEGER AS sentences
FROM documents
""")
def q_sentence_count(spark, sf):
    return text.sentence_counts(documents(spark, sf), "doc_id", "text")


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x IN ({STOP_SQL}))) / nullif(len(w), 0)::DOUBLE AS stop_ratio FROM w
""")
def q_stopword_ratio(spark, sf):
    return text.stop_word_ratio(documents(spark, sf), "doc_id", "text", text.STOP_WORDS)


@query(f"SELECT term, sum(tf)::BIGINT AS count, count(*) AS documents FROM ({TF}) GROUP BY term")
def q_word_freq(spark, sf):
    return text.word_frequency(documents(spark, sf), "doc_id", "text")


@query(f"""
WITH w AS (SELECT {WORDS} AS w FROM documents),
p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w WHERE len(w) > 1)
SELECT bigram, count(*) AS count FROM p GROUP BY bigram
""")
def q_bigrams(spark, sf):
    return text.bigram_frequency(documents(spark, sf), "text")


@query(f"""
WITH tf AS ({TF}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) AS weight FROM tf JOIN df USING (term))
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INTEGER AS rank FROM w
QUALIFY rank <= 3
""")
def q_tfidf_top(spark, sf):
    return text.top_terms(text.tf_idf(documents(spark, sf), "doc_id", "text"), "doc_id", 3)


@query(f"""
WITH s AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM s),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) AS weight FROM tf JOIN df USING (term))
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INTEGER AS rank FROM w
QUALIFY rank <= 3
""")
def q_tfidf_bigrams(spark, sf):
    weights = text.tf_idf(documents(spark, sf), "doc_id", "text", (1, 2))
    return text.top_terms(weights, "doc_id", 3)


@query(f"""
WITH t AS (SELECT doc_id, lang = 'en' AS pos, unnest(list_distinct({WORDS})) AS term FROM documents),
n AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (lang = 'en'))::DOUBLE AS p FROM documents),
c AS (SELECT term, (count(*) FILTER (pos))::DOUBLE AS a, (count(*) FILTER (NOT pos))::DOUBLE AS b FROM t GROUP BY term),
x AS (SELECT term, a, b, p - a AS c, n - p - b AS d, n FROM c, n)
SELECT term, (a + b)::BIGINT AS documents,
       coalesce(n * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 0) AS chi2 FROM x
""")
def q_chi_square(spark, sf):
    return text.chi_square(documents(spark, sf), "doc_id", "text", F.col("lang") == "en")


@query(f"""
WITH t AS (SELECT doc_id, coalesce(lang = 'en', false) AS pos, unnest(list_distinct({WORDS})) AS term FROM documents),
n AS (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (lang = 'en'))::DOUBLE AS p FROM documents),
c AS (SELECT term, (count(*) FILTER (pos))::DOUBLE AS a, (count(*) FILTER (NOT pos))::DOUBLE AS b FROM t GROUP BY term),
x AS (SELECT term, a, b, p - a AS c, n - p - b AS d, n, p FROM c, n)
SELECT term, (a + b)::BIGINT AS documents, round(
    CASE WHEN a > 0 THEN a / n * ln(a * n / ((a + b) * p)) ELSE 0 END + CASE WHEN b > 0 THEN b / n * ln(b * n / ((a + b) * (n - p))) ELSE 0 END
  + CASE WHEN c > 0 THEN c / n * ln(c * n / ((c + d) * p)) ELSE 0 END + CASE WHEN d > 0 THEN d / n * ln(d * n / ((c + d) * (n - p))) ELSE 0 END
  , 9) + 0.0::DOUBLE AS information FROM x
""")
def q_mutual_information(spark, sf):
    found = text.mutual_information(documents(spark, sf), "doc_id", "text", F.col("lang") == "en")
    return found.withColumn("information", F.round("information", 9) + 0.0)


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
FROM part
""")
def q_slugify(spark, sf):
    name = F.concat("p_name", F.lit(" / "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", slug(name).alias("slug"))
