"""License scans by diagonal voting, in DataFrame functions only.

Words are runs of letters and digits (and of all characters beyond ASCII), A-Z lower-cased. A template is a
short text with a label: a *phrase* counts where its words stand one after another, a *notice* where most of it
stands, a few words put in or left out.

1. Every run of k words of every text (k = 2 for phrases, 3 for notices) is hashed and joined to the positions of the
   same run in the templates; the words themselves are compared too, so that a vote is exact.
2. Votes are counted by diagonal, the offset between the place in the text and the place in the template. A phrase
   stands where one diagonal has all votes.
3. Neighbouring diagonals of a notice, at most a quarter of its words apart, are merged: a word put in moves the rest
   to the next diagonal. Every diagonal also stands alone, so that a notice repeated end to end is not lost.
4. A span of a notice is verified: at least ``share`` of the template's runs lie in it, among them all runs that hold a
   number (a version is never guessed), and it is at most half as long again as the template.

The templates are a parameter, are held by the driver and broadcast: their size is that of a few license
texts (at most ``MOST_WORDS`` words, else an error) and does not grow with the corpus. Votes are shuffled by (doc_id, digest of the
text), so equal texts under different ids spread, and rows equal in both are voted on once; texts without any vote are
not shuffled. The largest group is the votes of one text.

Null and empty texts have no words and no spans. Rows without doc_id are scanned like others. Repeated rows get
equal results each. An empty table gives an empty result. Overlapping spans are all returned, ordered by place, then label.
Columns of the input that bear an output's name are replaced by ``scan``; others stay.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from statloom.llm.tables import free_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
"""Between words, in a text without A-Z."""

MOST_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(GAP, self.text.translate(str.maketrans(UPPER, LOWER))) if w]


# Phrases and their labels.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]

# Notices as the licenses themselves ask to print them.
NOTICES = [
    Template("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0"),
    Template("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "Released under the MIT License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

SPAN = "struct<start:long,stop:long,label:string,coverage:double,phrase:boolean>"


OWN = ["template", "label", "phrase", "length", "total", "slack", "needed"]
"""What a template says of itself; ``total`` is its number of runs, ``needed`` are the places of runs with a number."""


def words(text: Column) -> Column:
    """The words of a text; none of a null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, GAP), "")


def run_hash(k: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(k), *parts[:k])


def positions(spark: SparkSession, templates: Sequence[Template], runs: tuple[int, int]) -> DataFrame:
    """(run, t1 .. tk, place) and the columns ``OWN``: every k-word run of every template."""
    rows = []
    for number, t in enumerate(templates):
        parts, k = t.words, runs[0] if t.phrase else runs[1]
        if len(parts) < k:
            raise ValueError(f"a template needs {k} words: {t.text!r}")
        grams = [parts[i : i + k] for i in range(len(parts) - k + 1)]
        slack = 0 if t.phrase else max(1, len(parts) // 4)
        needed = [i for i, g in enumerate(grams) if any(w.isdigit() for w in g)]
        rows += [(k, *g, *[None] * (max(runs) - k), number, i, t.label, t.phrase, len(parts), len(grams), slack, needed) for i, g in enumerate(grams)]
    if len(rows) > MOST_WORDS:
        raise ValueError("too many template words to broadcast")
    names = ", ".join(f"t{i + 1} string" for i in range(max(runs)))
    table = spark.createDataFrame(rows, f"k int, {names}, template int, place int, label string, phrase boolean, length int, total int, slack int, needed array<int>")
    parts = [F.col(f"t{i + 1}") for i in range(max(runs))]
    return table.withColumn("run", F.when(F.col("k") == runs[0], run_hash(runs[0], *parts)).otherwise(run_hash(runs[1], *parts))).drop("k")


def votes(docs: DataFrame, templates: Sequence[Template], runs: tuple[int, int] = (2, 3)) -> DataFrame:
    """(doc_id, digest, diagonal, place) of every run that a text shares with a template, and the columns ``OWN``."""
    wide = max(runs)
    parts = [F.col(f"w{i + 1}") for i in range(wide)]
    listed = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    ahead = [F.col("words") if i == 0 else F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))) for i in range(wide)]
    grams = listed.select("doc_id", "digest", F.posexplode(F.arrays_zip(*[a.alias(f"w{i + 1}") for i, a in enumerate(ahead)])).alias("at", "g"))
    grams = grams.select("doc_id", "digest", "at", *[F.col(f"g.w{i + 1}") for i in range(wide)])
    rolled = grams.withColumn("run", F.explode(F.array(*[F.when(parts[k - 1].isNotNull(), run_hash(k, *parts)) for k in runs])))
    met = rolled.join(F.broadcast(positions(docs.sparkSession, templates, runs)), "run")
    for i in range(wide):
        met = met.filter(F.col(f"t{i + 1}").isNull() | (F.col(f"t{i + 1}") == F.col(f"w{i + 1}")))
    return met.select("doc_id", "digest", *OWN, (F.col("at") - F.col("place")).cast("long").alias("diagonal"), "place")


def spans(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), runs: tuple[int, int] = (2, 3), share: float = 0.8) -> DataFrame:
    """(doc_id, digest, spans): verified spans of every text that has any, sorted."""
    text, k = ["doc_id", "digest"], F.when(F.col("phrase"), runs[0]).otherwise(runs[1])
    lines = votes(docs, templates, runs).groupBy(*text, *OWN, "diagonal").agg(F.collect_set("place").alias("places"))
    along = Window.partitionBy(*text, "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    lines = lines.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("cluster", F.sum("far").over(along))
    line = F.struct(
        (F.col("diagonal") + F.array_min("places")).alias("start"),
        (F.col("diagonal") + F.array_max("places") + k).alias("stop"),
        "places",
    )
    merged = lines.groupBy(*text, *OWN, "cluster").agg(F.collect_list(line).alias("lines"))
    spot = lambda start, stop, places: F.struct(start.alias("start"), stop.alias("stop"), places.alias("found"))
    all_of_it = spot(F.array_min("lines.start"), F.array_max("lines.stop"), F.array_distinct(F.flatten("lines.places")))
    alone = F.transform("lines", lambda x: spot(x["start"], x["stop"], x["places"]))
    spots = merged.select(*text, *OWN, F.explode(F.concat(alone, F.array(all_of_it))).alias("spot")).select(*text, *OWN, "spot.*")
    spots = spots.withColumn("coverage", F.size("found") / F.col("total"))
    long = F.col("stop") - F.col("start")
    right = F.when(F.col("phrase"), (F.size("found") == F.col("total")) & (long == F.col("length")))
    right = right.otherwise((F.col("coverage") >= share) & (F.size(F.array_except("needed", "found")) == 0) & (2 * long <= 3 * F.col("length")))
    one = F.struct(*[F.col(f.split(":")[0]) for f in SPAN[7:-1].split(",")]).cast(SPAN)
    return spots.filter(right).groupBy(*text).agg(F.array_sort(F.collect_set(one)).alias("spans"))


def scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), runs: tuple[int, int] = (2, 3), share: float = 0.8) -> DataFrame:
    """All rows with ``n_words`` and ``spans``, an array of (start, stop, label, coverage, phrase); word places from 0, stop exclusive."""
    out = ("n_words", "spans")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in out])
    other, digest, theirs = free_names(docs, "_id", "_digest", "_their")
    found = spans(docs, templates, runs, share).select(F.col("doc_id").alias(other), F.col("digest").alias(theirs), "spans")
    rows = docs.withColumn(digest, F.xxhash64("text")).withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found[other]) & (rows[digest] == found[theirs]), "left").drop(digest, theirs, other)
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and the best score of each row of ``scan``.

    The score is the largest share of a template that a verified span holds: 1 for a phrase, 0 without a span.
    """
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
