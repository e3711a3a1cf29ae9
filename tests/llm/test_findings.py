"""Cases that earlier versions missed, and brute-force versions of the shard tree and the language profiles."""

import math
import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import decontaminate, language, shard_tree
from statloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_short_items_are_found_inside_documents(spark):
    docs = spark.createDataFrame([(1, "x y alpha Beta gamma z w"), (2, "alpha beta"), (3, "alpha gamma beta"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ALPHA beta gamma"), (2, "beta"), (3, "w"), (4, "alpha beta"), (5, "gamma z w v q")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 2)}


def test_leaks_without_id_go(spark):
    text = "one two three four five six seven"
    rows = [(None, f"so {text} ok", 1), (None, "clean text", 2), (None, None, 3), (7, text, 4), (8, "clean text", 5), (8, text, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["_key"] for r in kept.collect()) == [2, 3]


def test_a_language_under_one_id_is_learned(spark):
    rows = [(5, f"der hund läuft über die straße nummer {i}", "de") for i in range(3000)] + [(5, "der hund", "de")] * 500
    rows += [(i, f"the dog runs across the street number {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("H", F.lit(1)).withColumn("of", F.lit("x"))
    names, prototypes = language.train(docs)
    assert names == ["de", "en"]
    asked = spark.createDataFrame([(1, "die straße und der hund"), (2, "the street and the dog"), (3, "123")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, names, prototypes).collect()} == {1: "de", 2: "en", 3: "und"}
    assert language.train(docs.filter("lang = 'xx'"))[0] == []


def test_language_profiles_by_plain_loops(spark):
    """Prototypes, cosines and scores from letters' vectors, one n-gram at a time."""
    texts = {"aa": ["abc abc", "bca"], "bb": ["xyz", "zyx xy"], "cc": ["mno"]}
    docs = spark.createDataFrame([(i, t, k) for k, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, text string, lang string")
    names, prototypes = language.train(docs)

    def vector(text):
        padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        total = np.zeros(language.DIMENSIONS)
        for i in range(len(padded) - 2):
            one = np.ones(language.DIMENSIONS)
            for place, c in enumerate(padded[i : i + 3]):
                one = one * np.roll(language.signs(np.array([ord(c)]))[0], 2 - place)
            total += one
        return total / np.linalg.norm(total)

    sums = [sum(vector(t) for t in texts[k]) for k in names]
    unit = np.array([s / np.linalg.norm(s) for s in sums])
    unit -= unit.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert names == ["aa", "bb", "cc"] and np.allclose(prototypes, unit, atol=1e-5)
    asked = [(1, "Abc!"), (2, "zyx"), (3, "o-n-m"), (4, "abz")]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), names, prototypes).collect()}
    for i, text in asked:
        power = [math.exp(language.SHARP * float(vector(text) @ p)) for p in unit]
        assert got[i]["lang_pred"] == names[int(np.argmax(power))] and got[i]["score"] == pytest.approx(max(power) / sum(power), abs=1e-4)


def draw(name, weight, key):
    """The draw of a child by the public hash function, seeded as the SQL function seeds it."""
    mixed = xxhash.xxh64_intdigest(name.encode(), 42)
    if key is not None:
        mixed = xxhash.xxh64_intdigest(int(key).to_bytes(8, sys.byteorder, signed=True), mixed)
    return -math.log(((mixed >> 11) + 1) / 2**53) / weight


def descend(node, key):
    while node.children:
        node = min((c for c in node.children if c.weight > 0), key=lambda c: draw(c.name, c.weight, key))
    return node.shard


def test_shards_by_plain_descent(spark):
    keys = [*range(300), None, -1, 2**40]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for root in (shard_tree.tree(16), shard_tree.grow(shard_tree.tree(16), 16), shard_tree.tree(7, 2, 2, {0: 0.0, 3: 5.0})):
        got = {r["doc_id"]: r["shard"] for r in shard_tree.assign(df, "doc_id", root).collect()}
        assert got == {k: descend(root, k) for k in keys}


def test_shard_query_by_plain_descent(spark):
    old, new = shard_tree.tree(16), shard_tree.grow(shard_tree.tree(16), 16)
    rows = QUERIES["op1_hash_tree_shards"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert (r["shard"], r["grown_shard"], r["size"]) == (descend(old, r["doc_id"]), descend(new, r["doc_id"]), len(texts[r["doc_id"]].encode()) + 1)
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_quality_trusts_every_good_text(spark):
    import numpy as np

    from statloom.llm import quality

    docs = spark.range(6_200).selectExpr("id AS doc_id", "concat_ws(' ', 'some words', hex(id * 7919), sha2(string(id), 256)) AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id < 6000, 1, 0) AS quality").unionByName(docs.limit(50).selectExpr("doc_id", "1 AS quality"))
    good = quality.trusted_texts(docs, labels)
    model = quality.fit(docs, labels)
    scores = quality.score(good, model).toPandas()["score"]
    trusted, raw = quality.count_grams(docs.where("doc_id < 6000")), quality.count_grams(docs)
    ratio = np.log((trusted + 1) / (trusted.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert good.count() == 6_000 and np.allclose(model.ratio, ratio, atol=1e-12)
    assert abs(model.threshold - (np.quantile(scores, 0.01) - quality.MARGIN)) < 1e-12
