"""Merkle manifest of a dataset, its hash trees stored in van Emde Boas layout.

Each row is a leaf, H of its columns; every group of rows has a tree over its leaves in key order, and one more tree
stands over the groups' roots. In a tree each run of eight nodes (the last may be shorter) becomes their H, level by
level, until one node is left. H is the hex SHA-256 of its inputs, one after the other.

1. Rows are ordered by a range partitioning on (group, key); a row's position in its group is its place in its
   partition and the group's rows in partitions before. Equal keys are ordered by their leaf, so repeated rows do no
   harm, however many they are, and the root does not depend on how the table is partitioned.
2. Aligned runs of 8 ** ``height`` leaves are *blocks*. A task builds a block's complete subtree and stores it as one
   binary value in van Emde Boas order: a subtree of L levels is cut at half height into a top and its bottoms, each
   stored whole and cut again. ``address`` finds a node by this arithmetic alone, both while the tree is built and
   while siblings are read.
3. The blocks' roots are the leaves of the next level of blocks, until every group has one block; the groups' roots
   go the same way.
4. Proofs go down: a block gets the siblings above it by a join on (group, block) and adds those inside. A proof is checked by
   folding a claimed leaf with its siblings.

No task ever holds more than one block (4,096 leaves) at a time, whatever the size of a group, and all levels are written tables, so a lost
executor costs only its tasks. Null keys come first; a null group is a group of its own and comes first. Null columns are
leaves' ``-``. A group of one row has that leaf as its root, and so has a single group. An empty table has no root
and an empty result. Columns of the table that are not named take no part; names never clash, since only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.tables import arrow, ship, written

FAN = 8
HEIGHT = 4
"""Levels of a block above its leaves."""

BLOCKS_AT_ONCE = 32
"""Blocks (of at most a megabyte) in an Arrow batch."""

PLACE_BITS = 33
"""``monotonically_increasing_id`` keeps the place within a partition in these bits."""


def digest(*columns: str) -> Column:
    """H of a row: each column as its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (F.col(c).cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_in(levels: int) -> int:
    """Nodes of a complete subtree."""
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes of a depth (the root has 0) lie in a subtree of that many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(depth, index, top)
    width = FAN ** (depth - top)
    return nodes_in(top) + index // width * nodes_in(levels - top) + address(depth - top, index % width, levels - top)


def levels_of(leaves: int, height: int) -> int:
    """Levels of a block in a tree of so many leaves: as few as reach one root, or all when blocks follow above."""
    levels = 1
    while FAN ** (levels - 1) < min(leaves, FAN**height):
        levels += 1
    return levels


def counts(held: int, levels: int) -> list[int]:
    """Nodes at each depth above ``held`` leaves."""
    out = [held]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def build(leaves: list[str], levels: int) -> bytes:
    """The subtree above some leaves; what lies behind its last node is left out."""
    size = counts(len(leaves), levels)
    at = [address(d, np.arange(size[d]), levels) for d in range(levels)]
    store = np.zeros((1 + max(int(a.max()) for a in at), 32), np.uint8)
    store[at[-1]] = np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32)
    for d in range(levels - 2, -1, -1):
        below = store[at[d + 1]].tobytes().hex()
        made = [hashlib.sha256(below[i : i + 64 * FAN].encode()).digest() for i in range(0, len(below), 64 * FAN)]
        store[at[d]] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 32)
    return store.tobytes()


def siblings(nodes: bytes, held: int, levels: int) -> Iterator[tuple[str, list[str], list[str]]]:
    """Each leaf with the siblings to its left and to its right, level by level upwards inside its block."""
    store = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    size, sides = counts(held, levels), []
    for d in range(levels - 1, 0, -1):
        text = store[address(d, np.arange(size[d]), levels)].tobytes().hex()
        runs = [text[i : i + 64 * FAN] for i in range(0, len(text), 64 * FAN)]
        sides.append([(run[: 64 * j], run[64 * (j + 1) :]) for run in runs for j in range(len(run) // 64)])
    leaves = store[address(levels - 1, np.arange(held), levels)].tobytes().hex()
    for i in range(held):
        path = [side[i // FAN**up] for up, side in enumerate(sides)]
        yield leaves[64 * i : 64 * (i + 1)], [p[0] for p in path], [p[1] for p in path]


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place from 0 in the order within ``grp``, and ``n``, the rows of the group."""
    own = [c for c in rows.columns if c != "grp"]
    spread = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    along = [F.col(c).asc_nulls_first() for c in ("grp", *order, "tie")]
    placed = spread.repartitionByRange(*along).sortWithinPartitions(*along).drop("tie")
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", PLACE_BITS)).withColumn("at", F.col("at").bitwiseAND((1 << PLACE_BITS) - 1))
    parts = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"n": F.sum("held").over(Window.partitionBy("grp")), "before": F.coalesce(F.sum("held").over(before), F.lit(0))})
    return placed.join(parts.drop("held"), ["grp", "part"]).select("grp", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n", *own)


def packer(carry: Sequence[str], height: int):
    """What turns the rows of one block into one row."""

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by("slot")
        nodes = build(block["leaf"].to_pylist(), levels_of(block["n"][0].as_py(), height))
        first = [block[c].slice(0, 1) for c in ("grp", "block", "n")]
        lists = [pa.array([block[c].to_pylist()], pa.list_(block[c].type)) for c in carry]
        more = [pa.array([len(block)], pa.int32()), pa.array([nodes[:32].hex()]), pa.array([nodes])]
        return pa.table([*first, *more, *lists], names=["grp", "block", "n", "held", "root", "nodes", *carry])

    return pack


def forest(rows: DataFrame, carry: Sequence[str], height: int) -> list[DataFrame]:
    """Written blocks of each level over (grp, pos, n, leaf): those of level 0 also hold the ``carry`` columns as lists."""
    size, tables = FAN**height, []
    ship(rows.sparkSession)
    while True:
        kinds = {c: rows.schema[c].dataType.simpleString() for c in carry}

        parted = rows.withColumns({"block": F.floor(F.col("pos") / size), "slot": F.col("pos") % size})
        schema = ", ".join(["grp string, block long, n long, held int, root string, nodes binary", *[f"{c} array<{k}>" for c, k in kinds.items()]])
        blocks = written(parted.drop("pos").groupBy("grp", "block").applyInArrow(packer(carry, height), schema))
        tables.append(blocks)
        more = blocks.filter(F.col("n") > size)
        if more.isEmpty():
            return tables
        rows = more.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("leaf"))
        carry = ()


def tops(tables: Sequence[DataFrame], height: int) -> DataFrame:
    """(grp, root) of every tree."""
    out = None
    for blocks in tables:
        top = blocks.filter(F.col("n") <= FAN**height).select("grp", "root")
        out = top if out is None else out.unionByName(top)
    return out


PATH = "subroot string, lefts array<string>, rights array<string>"


def in_small_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` on a table of blocks, written."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    ship(spark)
    usual = spark.conf.get(name)
    spark.conf.set(name, str(BLOCKS_AT_ONCE))
    try:
        return written(arrow(df, run, schema))
    finally:
        spark.conf.set(name, usual)


def descend(tables: Sequence[DataFrame], paths: DataFrame, height: int) -> DataFrame:
    """The blocks of level 0 with the siblings above them, given those above each tree (grp and ``PATH``)."""
    size, above = FAN**height, None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                found = siblings(b["nodes"], b["held"], levels_of(b["n"], height))
                out = [
                    {"grp": b["grp"], "block": b["block"] * size + i, "subroot": b["subroot"], "lefts": own + b["lefts"], "rights": other + b["rights"]}
                    for i, (_, own, other) in enumerate(found)
                ]
                yield pa.RecordBatch.from_pylist(out, SPREAD)

    for level in reversed(range(len(tables))):
        blocks = tables[level]
        now = blocks.filter(F.col("n") <= size).join(paths, "grp")
        if above is not None:
            now = now.unionByName(blocks.filter(F.col("n") > size).join(above, ["grp", "block"]))
        if level == 0:
            return now
        above = in_small_batches(now, spread, f"grp string, block long, {PATH}")


STRINGS = pa.list_(pa.string())
SPREAD = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("lefts", STRINGS), ("rights", STRINGS)])


@dataclass
class Manifest:
    """Blocks of the groups' trees and of the tree above them, by level, and the root of all (None of an empty table)."""

    groups: list[DataFrame]
    above: list[DataFrame]
    root: str | None
    height: int


def manifest(df: DataFrame, key: str, group: str, leaf: Column, claimed: Column | None = None, height: int = HEIGHT) -> Manifest:
    """Trees over the leaves of each group in key order.

    ``claimed`` is a leaf to be checked against the trees in place of a row's own (null: its own).
    """
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = df.select(grp.alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    groups = forest(ranked(rows, ["key", "leaf"]), ["key", "claimed"], height)
    roots = tops(groups, height).select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("leaf"))
    above = forest(ranked(roots, ["member"]), ["member"], height)
    root = tops(above, height).first()
    return Manifest(groups, above, None if root is None else root["root"], height)


def proofs(made: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``proof_sha256`` is H of the siblings of the leaf up to the root of all, ``folded_root`` what the claimed leaf folds to
    with them.
    """
    spark, height, root = made.groups[0].sparkSession, made.height, made.root

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                found = siblings(b["nodes"], b["held"], levels_of(b["n"], height))
                out = [
                    {"grp": m, "subroot": leaf, "lefts": own + b["lefts"], "rights": other + b["rights"]}
                    for m, (leaf, own, other) in zip(b["member"], found)
                ]
                yield pa.RecordBatch.from_pylist(out, SPREAD.remove(1))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                b = {c: batch[c][i].as_py() for c in ("nodes", "held", "n", "subroot", "lefts", "rights", "claimed")}
                above = "".join(x + y for x, y in zip(b["lefts"], b["rights"]))
                leaves, proof, folded = [], [], []
                for claim, (leaf, lefts, rights) in zip(b["claimed"], siblings(b["nodes"], b["held"], levels_of(b["n"], height))):
                    leaves.append(leaf)
                    proof.append(hashed("".join(x + y for x, y in zip(lefts, rights)) + above))
                    now = claim or leaf
                    for x, y in zip(lefts + b["lefts"], rights + b["rights"]):
                        now = hashed(x + now + y)
                    folded.append(now)
                keys = batch["key"][i].values
                texts = [leaves, [b["subroot"]] * len(leaves), [root] * len(leaves), proof, folded]
                right = pa.array([f == root for f in folded])
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.string()) for x in texts], right], names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    start = spark.createDataFrame([("", None, [], [])], f"grp string, {PATH}")
    paths = in_small_batches(descend(made.above, start, height), members, f"grp string, {PATH}")
    kind = made.groups[0].schema["key"].dataType.elementType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return in_small_batches(descend(made.groups, paths, height), fold, schema)
