"""License scans against a brute-force reading of every text."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm import license
from statloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def phrases(text):
    w = words(text)
    return sorted((i, l) for p, l in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def notices(text, share=0.8, k=3):
    """All verified spans by counting over every pair of positions."""
    w, out = words(text), set()
    for t in license.NOTICES:
        p = t.words
        total, slack = len(p) - k + 1, max(1, len(p) // 4)
        lines = {}
        for i, j in itertools.product(range(len(w) - k + 1), range(total)):
            if w[i : i + k] == p[j : j + k]:
                lines.setdefault(i - j, set()).add(j)
        groups, last = [], None
        for d in sorted(lines):
            if last is None or d - last > slack:
                groups.append([])
            groups[-1].append(d)
            last = d
        for g in [*groups, *[[d] for d in lines]]:
            found = set().union(*[lines[d] for d in g])
            lo, hi = min(d + min(lines[d]) for d in g), max(d + max(lines[d]) + k for d in g)
            numbers = {j for j in range(total) if any(x.isdigit() for x in p[j : j + k])}
            if len(found) >= share * total and numbers <= found and 2 * (hi - lo) <= 3 * len(p):
                out.add((lo, hi, t.label, len(found) / total))
    return out


TEXTS = [
    None,
    "",
    " \n\t",
    "MIT",
    "the MIT-License, mit license; cc by CC-BY_nc",
    "GNU General Public License GNU General Public License",
    "gnu general general public license",
    "Released under the MIT License. Released under the MIT License. Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the GNU General Public License, version 33",
    "x " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files ok",
    "Licensed under the very Apache License, Version 2.0 é中 apache license",
    "Kit license İ mit license",
    "Redistribution and use in source and binary forms with modification are permitted",
    "of the of the of the " * 3000,
    "word " * 60_000 + "Licensed under CC BY-NC 4.0.",
    "mit license " * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "mine") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "mine"), (4, "mit license", "mine"), (None, TEXTS[8], "mine"), (None, None, "mine")]
    return spark.createDataFrame(rows, "doc_id long, text string, Spans string").withColumn("template", F.lit("t")).withColumn("_digest", F.lit(1))


def test_against_brute_force(docs):
    got = license.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["text"]
        assert r["n_words"] == len(words(text)) and r["template"] == "t" and r["_digest"] == 1
        base = [(s["start"], s["label"]) for s in r["spans"] if s["phrase"]]
        assert base == phrases(text)
        if len(text or "") < 5000:
            assert {(s["start"], s["stop"], s["label"], s["coverage"]) for s in r["spans"] if not s["phrase"]} == notices(text)


def test_long_texts_and_versions(docs):
    by = {r["doc_id"]: r for r in license.summary(license.scan(docs.filter("doc_id != 4"))).collect()}
    assert by[15]["labels"] == "cc-by,cc-by-nc-4.0" and by[15]["first_word"] == 60_002
    assert by[16]["n_base"] == 5000 and by[16]["last_word"] == 9998
    assert by[8]["labels"] == "gpl,gpl-3.0" and by[9]["labels"] == "gpl"
    assert by[10]["labels"] == "mit" and by[10]["base_labels"] == "" and 0.8 <= by[10]["score"] < 1
    assert by[0]["score"] == 0 and by[0]["first_word"] is None and by[14]["labels"] == ""


def test_own_templates_and_empty_table(spark, docs):
    own = [license.Template("own", "one two three four five six"), license.Template("it", "one two", True)]
    one = spark.createDataFrame([(1, "zero one two three oops four five six")], "doc_id long, text string")
    spans = license.scan(one, own, share=0.5).first()["spans"]
    assert [(s["label"], s["start"], s["stop"]) for s in spans] == [("it", 1, 3), ("own", 1, 8)]
    assert license.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license.scan(one, [license.Template("short", "one two")])


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_license_diagonals"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base, more = phrases(texts[r["doc_id"]]), notices(texts[r["doc_id"]]) if "icens" in (texts[r["doc_id"]] or "") else set()
        places = [i for i, _ in base]
        assert (r["n_words"], r["n_base"]) == (len(words(texts[r["doc_id"]])), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({l for _, l in base}))
        assert r["labels"] == ",".join(sorted({l for _, l in base} | {s[2] for s in more}))
        assert r["score"] == max([1.0] * bool(base) + [s[3] for s in more], default=0.0)
