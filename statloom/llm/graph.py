"""Connected components by contraction.

In each round every vertex takes the least of its neighbours and itself, edges are drawn
between what their ends took, and loops go. Ids are hashed first, so that a round removes
a constant share of the vertices whatever their order, and long chains fold in
logarithmic time. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b), both long; labels are vertices.

    Loops and repeated edges are allowed; rows with a null end are left out.
    """
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = written(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = written(ends.select("v", F.col("v").alias("label")))
    edges = edges.filter("a != b")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(mixed("b")).alias("b")).select("a", F.least("b", mixed("a"))["v"].alias("to"))
        least = written(least)
        moved = labels.join(least.withColumnRenamed("a", "label"), "label", "left")
        labels = written(moved.select("v", F.coalesce("to", "label").alias("label")))
        new = edges.join(least.withColumnRenamed("to", "x"), "a").join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = written(new.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels
