"""Row positions over files and blocks, joins by position, display rounding."""

import pytest
from pyspark.sql import functions as F

from statloom.functions.scalars import half_even, rounded
from statloom.sources import positions


@pytest.mark.parametrize("block", ["1000", "128m"])
def test_positions_follow_files_and_lines(spark, tmp_path, block):
    lines = [[f"{f * 1000 + i},{'x' * (i % 50)}" for i in range(n)] for f, n in enumerate([300, 1, 0, 450])]
    for f, rows in enumerate(lines):
        (tmp_path / f"part-{f}.csv").write_text("".join(r + "\n" for r in rows))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = positions.read_numbered(spark, str(tmp_path), "id long, s string").orderBy("position").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["position"] for r in got] == list(range(751))
    assert [r["id"] for r in got] == [f * 1000 + i for f, n in enumerate([300, 1, 0, 450]) for i in range(n)]


def test_bind(spark, tmp_path):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(7)], "k int, v string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(5)], "k int, V string")
    positions.write_parts(a, str(tmp_path / "a"), ["k"], 3)
    positions.write_parts(b, str(tmp_path / "b"), ["k"], 2)
    left, right = (positions.read_numbered(spark, str(tmp_path / n), s) for n, s in (("a", "k int, v string"), ("b", "k int, V string")))
    got = positions.bind(left, right).orderBy("position")
    assert got.columns == ["position", "k", "v", "k_right", "V_right"]
    assert [(r["v"], r["V_right"]) for r in got.collect()] == [(f"a{i}", f"b{i}" if i < 5 else None) for i in range(7)]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5, "a"), (1.5, "b"), (2.5, "c"), (-0.5, "d"), (None, "e")], "x double, s string")
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, 0.0, None]
    assert [r["x"] for r in rounded(df.withColumn("x", F.col("x") / 4)).collect()] == [0.12, 0.38, 0.62, -0.12, None]
