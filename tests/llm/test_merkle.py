"""Merkle manifests against a plain reading of their definition."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 8])))
        i //= 8
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded) with every third id's text lower-cased."""
    groups = defaultdict(list)
    for d, t, lang in rows:
        low = t.translate({c: c + 32 for c in range(65, 91)}) if t is not None else None
        tampered = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[lang].append((d is not None, d or 0, leaf_of(d, t, lang), leaf_of(d, low if tampered else t, lang)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in names}
    above = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (known, d, leaf, claimed) in enumerate(sorted(groups[g])):
            steps = path(trees[g], i) + path(above, at)
            folded = claimed
            for x, y in steps:
                folded = sha(x + folded + y)
            out.append((d if known else None, leaf, trees[g][-1][0], above[-1][0], sha("".join(x + y for x, y in steps)), folded))
    return sorted(out, key=str)


def run(spark, rows, height, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("GRP", F.lit("x")).withColumn("Leaf", F.lit(1)).withColumn("tie", F.lit(2))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    low = df.withColumn("other", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    claimed = F.when(tampered, merkle.digest("doc_id", "other", "lang"))
    made = merkle.manifest(low, "doc_id", "lang", merkle.digest("doc_id", "text", "lang"), claimed, height)
    got = merkle.proofs(made).collect()
    assert all(r["verified"] == (r["folded_root"] == made.root) for r in got)
    return sorted([(r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got], key=str)


def table(n, langs):
    rng = np.random.default_rng(n)
    rows = [(int(i), f"Text {i} é", langs[int(k)]) for i, k in zip(rng.permutation(n), rng.integers(0, len(langs), n))]
    rows += [(3, "Text 3 again", "a"), (3, "Text 3 again", "a"), (None, "No id", "a"), (None, None, None), (7, None, None), (8, "", None)]
    return rows + [(5, "same", "hot")] * 150 + [(9, "x" * 200_000 + "Y", "long")]


@pytest.mark.parametrize(("n", "height"), [(700, 1), (700, 2), (200, 4)])
def test_against_definition(spark, n, height):
    rows = table(n, ["a", "b", "é", "z", "", "A"])
    assert run(spark, rows, height) == brute(rows)


def test_many_groups(spark):
    rows = [(i, f"T{i}", f"g{i}") for i in range(75)]
    assert run(spark, rows, 1) == brute(rows)


@pytest.mark.parametrize("size", [1, 7, 8, 9, 64, 65, 513])
def test_one_group(spark, size):
    rows = [(i, f"T{i}", "en") for i in range(size)]
    assert run(spark, rows, 2) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], 2) == []


def test_addresses():
    for levels in range(1, 6):
        found = [merkle.address(d, np.arange(8**d), levels) for d in range(levels)]
        assert sorted(np.concatenate(found).tolist()) == list(range(merkle.nodes_in(levels)))
        assert found[0][0] == 0
    top = np.concatenate([merkle.address(d, np.arange(8**d), 4) for d in (0, 1)])
    assert sorted(top.tolist()) == list(range(9))
    assert merkle.address(3, np.arange(8), 4).tolist() == list(range(10, 18)) and merkle.address(2, np.array([0]), 4)[0] == 9
