"""Files written by the test and read back."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from statloom.plans.catalog import Dataset, find_column
from statloom.plans.recipe import study_all
from statloom.sources import readers, sinks


def test_headerless(spark, tmp_path):
    (tmp_path / "a.data").write_text("63.0,1.0,?\n67.0,x,3.0\n")
    rows = readers.read_headerless(spark, str(tmp_path), ["age", "sex", "ca"]).orderBy("age").collect()
    assert [tuple(r) for r in rows] == [(63.0, 1.0, None), (67.0, None, 3.0)]


def test_blank_separated_many_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run_subject{k}.log").write_text("".join(f" {k}.5\t  {i} \n" for i in range(10)))
    df = readers.read_blank_separated(spark, str(tmp_path / "*.log"), ["a", "b"])
    head = readers.head_per_file(df, 3).withColumn("subject", readers.name_part(F.col("file"), r"subject(\d+)\.log"))
    got = sorted((r["subject"], r["a"], r["b"]) for r in head.collect())
    assert got == [(s, float(f"{s}.5"), float(i)) for s in "12" for i in range(3)]


def test_feature_names(spark, tmp_path):
    (tmp_path / "features.txt").write_text("1 tBody-mean()-X\n2 tBody-std()-X\n")
    assert readers.feature_names(spark, str(tmp_path / "features.txt")) == ["f001_tBody-mean()-X", "f002_tBody-std()-X"]


def test_tagged_latin1(spark, tmp_path):
    text = (
        '<!DOCTYPE x>\n<RECORD TOPICS="YES" NEWID="7">\n<TOPICS><D>cocoa</D><D>tea</D></TOPICS>\n'
        "<TEXT><TITLE>Café &amp; &lt;bar&gt;</TITLE><BODY>One\n  two <I>three</I></BODY></TEXT></RECORD>\n"
        '<RECORD NEWID="8"><TOPICS></TOPICS><TEXT>none</TEXT></RECORD>\n'
    )
    (tmp_path / "x.sgm").write_bytes(text.encode("latin-1"))
    rows = readers.read_tagged(spark, str(tmp_path), "RECORD", "NEWID", ["TITLE", "BODY"], ["TOPICS"]).orderBy("newid").collect()
    assert tuple(rows[0]) == (7, "Café & <bar>", "One two three", ["cocoa", "tea"])
    assert tuple(rows[1]) == (8, "", "", [])


def png(path, pixels):
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_features(spark, tmp_path):
    png(tmp_path / "img_1.png", [[(255, 255, 255), (0, 0, 0)]])
    png(tmp_path / "img_2.png", [[(255, 0, 0)], [(255, 0, 0)], [(255, 0, 0)]])
    rows = {r["image_id"]: r for r in readers.image_features(spark, str(tmp_path)).collect()}
    assert (rows["img_1"]["width"], rows["img_1"]["height"], rows["img_1"]["format"]) == (2, 1, "png")
    assert (rows["img_1"]["mean_intensity"], rows["img_1"]["std_intensity"]) == (127.5, 127.5)
    assert (rows["img_2"]["mean_intensity"], rows["img_2"]["std_intensity"]) == (76.0, 0.0)


def test_catalogue(spark, tmp_path):
    for folder, name in (("tables", "study_x.csv"), ("logs", "ml.log"), ("tables", "other.csv")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("abc")
    rows = readers.file_catalogue(spark, str(tmp_path), {"tables": "table", "logs": "log"}, ["study", "ml"]).collect()
    got = {(r["artifact"], r["artifact_type"], r["scope"], r["size_bytes"]) for r in rows}
    assert got == {("study_x.csv", "table", "study", 3), ("ml.log", "log", "ml", 3), ("other.csv", "table", "general", 3)}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_bundle(spark, tmp_path, fmt):
    paths = sinks.write_bundle({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path), fmt)
    assert set(paths) == {"a", "b"} and spark.read.format(fmt).option("header", True).load(paths["a"]).count() == 3


def test_study_isolates_failures(spark):
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2], i % 2) for i in range(50)], "x double, c string, t int")
    good = Dataset("good", "t", ["x"], ["c"])
    results, log = study_all(spark, {"good": (df, good), "bad": (df, Dataset("bad", "t", ["absent"]))})
    assert {r["dataset"]: r["status"] for r in log.collect()} == {"good": "ok", "bad": "failed"}
    assert results["good"]["summary"].count() == 2 and results["good"]["group_stats"].count() == 2
    assert find_column(df, "T") == "t" and find_column(df, "zzz") == "t"
