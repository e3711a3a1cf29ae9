"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each node
every child draws -ln(u) / weight, u being a hash of the child's name and the
row's key in (0, 1], and the smallest draw wins: a child gets rows in proportion to
its weight. Draws of children whose weight stays do not change, so reweighing or
adding a node moves rows only into or out of the subtrees whose weights changed.
``grow`` adds a shard as a subtree of its own: no other weight changes, and only the
new shard gains rows.

Null keys share one key. Repeated keys go to the same shard. Weights of 0 get nothing.
An empty table stays empty. Columns of the input that bear an output's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.tables import free_names, places


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number; an inner node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to ``shards`` - 1 in racks of ``per_rack`` and regions of ``racks`` racks."""
    weigh = weights or {}
    leaves = [Node(f"shard{s}", shard=s, own=weigh.get(s, 1.0)) for s in range(shards)]
    parts = [Node(f"rack{i}", tuple(leaves[j : j + per_rack])) for i, j in enumerate(range(0, shards, per_rack))]
    return Node("root", tuple(Node(f"region{i}", tuple(parts[j : j + racks])) for i, j in enumerate(range(0, len(parts), racks))))


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, in a region and a rack of its own."""
    leaf = Node(f"shard{shard}", shard=shard, own=weight)
    region = Node(f"region-of-{leaf.name}", (Node(f"rack-of-{leaf.name}", (leaf,)),))
    return Node(root.name, (*root.children, region))


def levels(root: Node) -> list[list[Node]]:
    """The nodes of each level below the root, children of one node side by side; weights of 0 left out."""
    out, now = [], [root]
    while any(n.children for n in now):
        now = [c for n in now for c in n.children if c.weight > 0]
        out.append(now)
    return out


def pick(values: list, at: Column) -> Column:
    """The value at a place that is a column."""
    written = [f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v) for v in values]
    return F.element_at(F.expr(f"array({', '.join(written)})"), at + 1)


def draw(name: Column, weight: Column, key: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(name, key), 11) + 1) / F.lit(float(1 << 53))
    return -F.ln(unit) / weight


def assign(df: DataFrame, key: str, root: Node, into: str = "shard") -> DataFrame:
    """Descend level by level; each step draws among the children of the node that the last one chose."""
    (spot,) = free_names(df, "_node")
    placed, parents = df.withColumn(spot, F.lit(0)), [root]
    for nodes in levels(root):
        counts = [sum(c.weight > 0 for c in p.children) for p in parents]
        firsts = [sum(counts[:i]) for i in range(len(counts))]
        first, count = pick(firsts, F.col(spot)), pick(counts, F.col(spot))
        draws = []
        for j in range(max(counts)):
            child = F.least(first + j, F.lit(len(nodes) - 1))
            drawn = draw(pick([n.name for n in nodes], child), pick([n.weight for n in nodes], child), F.col(key))
            draws.append(F.when(count > j, F.struct(drawn.alias("draw"), child.alias("child"))))
        best = draws[0] if len(draws) == 1 else F.least(*draws)
        placed, parents = placed.withColumn(spot, best["child"]), nodes
    return placed.withColumn(into, pick([n.shard for n in parents], F.col(spot)).cast("int")).drop(spot)


def number(df: DataFrame, key: str, rows: int, shard: str = "shard", into: str = "slot", ties: tuple[str, ...] = ()) -> DataFrame:
    """Gapless numbers from 0 within each shard, by key inside hash slices of the shard."""
    placed, spot = df.drop(into), free_names(df, "_place")[0]
    order = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    placed = places(placed, [shard], F.xxhash64(F.lit("slot"), F.col(key)), order, F.lit(1), spot, rows)
    return placed.withColumnRenamed(spot, into)
