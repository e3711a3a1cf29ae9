"""Whitening against plain numpy, with repeated, broken and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import whiten
from statloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """x, exact deviations, axes and eigenvalues of a list of vectors."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, deviation, centred, values[order], axes.T[order]


def compare(rows, vectors, ids, k):
    n, deviation, centred, values, axes = brute(vectors)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"] if "vec_id" in r else r["key"], []).append(r)
    assert set(got) == set(ids)
    table = np.zeros((len(ids), k))
    for at, i in enumerate(ids):
        own = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, k + 1))
        assert {r["n"] for r in own} == {n} and {r["deviation"] for r in own} == {deviation[at]}
        assert np.allclose([r["explained"] for r in own], values[:k] / values.sum(), rtol=1e-9)
        table[at] = [r["whitened"] for r in own]
    want = centred @ (axes[:k] / np.sqrt(values[:k])[:, None]).T
    for j in range(k):
        assert np.allclose(table[:, j], want[:, j], atol=1e-7) or np.allclose(table[:, j], -want[:, j], atol=1e-7)
    assert np.abs(table.T @ table / n - np.eye(k)).max() < 1e-9
    assert {r["identity_error"] for r in rows}.pop() < 1e-9


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))).astype(np.float32).tolist()
    vectors += [vectors[0]] * 400 + [vectors[1]] * 5 + [[0.0, -0.0, 1e-9, -1e-9, 2.5, -2.5]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    broken = [None, [], [1.0], [1.0] * 7, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [1.0, 1.0, float("inf"), 1.0, 1.0, 1.0], [3e38] * 6]
    rows += [(1000 + i, v, None) for i, v in enumerate(broken)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("X", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("h", F.lit(2))
    return df, vectors


def test_against_numpy(table):
    df, vectors = table
    for k in (6, 3):
        rows = whiten.long_form(*whiten.whiten(df, "vec_id", "embedding", k)).collect()
        compare(rows, vectors, range(len(vectors)), k)


def test_weight_one(spark, table):
    df, vectors = table
    done, model, error = whiten.whiten(df, "vec_id", "embedding", 6, "one")
    once = list({tuple(v): v for v in vectors}.values())
    n, _, _, values, _ = brute(once)
    assert model.n <= n and done.count() == len(vectors) and error < 1e-9


def test_flat_and_empty_tables(spark, table):
    df, _ = table
    flat = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)] + [(None, [1.0, 2.0], 1)], SCHEMA)
    line = spark.createDataFrame([(None if i == 4 else i, [float(i), 2.0 * i], 0) for i in range(9)], SCHEMA)
    for df in (flat, df.limit(0), flat.filter("vec_id IS NULL")):
        assert whiten.long_form(*whiten.whiten(df, "vec_id", "embedding")).count() == 0
    rows = whiten.long_form(*whiten.whiten(line, "vec_id", "embedding")).collect()
    assert len(rows) == 9 and {r["component"] for r in rows} == {1} and {round(r["explained"], 9) for r in rows} == {1.0}


def test_large_numbers():
    model = whiten.Whitening(3, np.array([3, 3]), float(1 << 61), np.zeros((0, 2)), np.zeros(0), 0.0)
    assert model.deviations(np.array([[1 << 61, 1]])) == [None]
    assert model.deviations(np.array([[2, 1]])) == [9]


def test_query(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    pairs = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    compare(QUERIES["op12_multiplicity_whitening"](spark, SF).collect(), [v for _, v in pairs], [i for i, _ in pairs], 32)
