"""Term weights by parts of the texts against a plain count."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from statloom.operators import text


@pytest.mark.parametrize("chars", [300, 10**9])
@pytest.mark.parametrize("lengths", [(1,), (1, 2)])
def test_weights_by_parts(spark, monkeypatch, chars, lengths):
    monkeypatch.setattr(text, "PART_CHARS", chars)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choices(["a", "B", "é", "of", "x1", "the"] + [f"w{i}" for i in range(60)], k=rng.randint(0, 40)))) for _ in range(60)]
    rows += [(90, None), (91, ""), (None, None), (92, "one"), (92, "one two")]
    counts = defaultdict(Counter)
    for key, words in rows:
        w = (words or "").lower().split()
        for n in lengths:
            counts[key].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    held = Counter(t for c in counts.values() for t in c)
    want = {(k, t): n * math.log((len(rows) + 1) / (held[t] + 1)) for k, c in counts.items() for t, n in c.items()}
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    weights = text.tf_idf(df, "k", "t", lengths)
    got = {(r["k"], r["term"]): r["weight"] for r in weights.collect()}
    assert weights.count() == len(want) and got == pytest.approx(want, rel=1e-12)
    if chars == 300:  # the texts go to their parts twice, the terms once
        assert weights._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(term") == 1
    top = text.top_terms(weights, "k", 3).collect()
    best = lambda k: sorted((-w, t) for (d, t), w in want.items() if d == k)[:3]
    assert {k: [t for _, t in best(k)] for k in counts if counts[k]} == {k: [r["term"] for r in sorted(top, key=lambda r: r["rank"]) if r["k"] == k] for k in counts if counts[k]}


def test_words_of_a_frequent_key_are_merged(spark, monkeypatch):
    """Terms are counted as numbers in Arrow batches, not exploded into rows; a frequent key is merged on the way."""
    rows = [(None if i % 2 else i, f"a b a w{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t string")
    assert "Generate" not in text.tf_idf(df, "k", "t")._jdf.queryExecution().toString()
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int32()), pa.array([None, 1, None], pa.int32()), pa.nulls(3, pa.int64()), pa.array([["a", "b", "a"], ["a"], []])], names=["p", "k", "d", "t"])] * 50
    want = [(0, None, "a", 100, 2, None), (0, 1, "a", 50, 2, None), (0, None, "b", 50, 1, None)]
    for words in (10, 10**6):
        monkeypatch.setattr(text, "PART_WORDS", words)
        got = [tuple(r.values()) for b in text.count_terms(iter(batches), True) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sorted(tuple(r.values()) for b in text.count_terms(iter(batches), False) for r in b.to_pylist()) == [(0, "a", 2), (0, "b", 1)]
