"""The corpus queries against their SQL, and the pipeline against its operators."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from statloom.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF), SQL[name], oracle.connect(SF)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op12_multiplicity_whitening"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    got = QUERIES[name](spark, SF).select("doc_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in docs.collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    step = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, SF).cache()
        step[name] = (before, now)
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    for name, (before, after) in list(step.items())[:-1]:
        assert after.columns == docs.columns and ids(after) <= ids(before)
    verdict = QUERIES["op5_quality_rules"](spark, SF)
    assert ids(step["quality rules"][1]) == ids(verdict.filter("kept"))
    last = now.toPandas()
    for _, part in last.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    leaks = ids(QUERIES["op9_benchmark_decontamination"](spark, SF))
    assert not leaks & set(last["doc_id"]) and last.groupby("doc_id").size().max() <= 3


def test_pii_counts(spark):
    from test_operators import brute_pii

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_pii_boosting"](spark, SF).collect():
        kinds = [k for _, _, k, _ in brute_pii(docs[r["doc_id"]])]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
