"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its columns, each written as byte count, colon
and value.  The rows of a group, in the order of their ids, are the leaves of
one tree in which every ``FAN`` consecutive nodes become their common hash; the
roots of the groups, in the order of their names, are the leaves of the last
tree.  A proof holds, level by level, the siblings left and right of the path
from a leaf to the root.

A leaf's rank in its group is a number whose digits to the base ``FAN`` are the
path of the leaf.  Ranks come from a range partitioning: place in the partition
plus rows of the partitions before, less the first place of the group.  Blocks
of ``FAN ** DIGITS`` consecutive ranks are brought together once; grouping the
digits away, last first, hashes the children of a node and nests them in it, all
without another shuffle.  What is left of a block is one row with the nested
nodes, and the roots of blocks are the nodes that the next round groups.  On the
way back the steps above a block are joined to its row, one row per block, and
transforms carry them down the nested nodes; one explode emits the leaves.  So a
task holds single blocks, however large a group is.

Cases: null and empty values differ in the leaf (``-`` and ``0:``).  Rows without
an id come first, rows without a group form the first group.  Rows that repeat
an id are ordered by their leaves; equal leaves are interchangeable.  Texts are
hashed whole.  An empty table has no proofs.  Only the id, the group, the leaf
and the columns in ``keep`` are returned; others, however called, are hashed if
they are named and left out otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import need, written

#: Nodes that become one.
FAN = 3
#: Levels of a block; it has FAN ** DIGITS nodes at most.
DIGITS = 5

#: A level of a proof: the siblings' digests left and right of the path.
STEP = "struct<left: string, right: string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: byte count, colon and value of every column, ``-`` for null."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[field(c) for c in columns]))


def root_from(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def siblings(path: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _levels(n: Column) -> Column:
    """How often n nodes are grouped until one remains."""
    powers = F.array(*[F.lit(FAN**k) for k in range(math.ceil(63 / math.log2(FAN)) - 1)])
    return F.size(F.filter(powers, lambda p: p < n))


def _placed(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``place``: rows before this one in the given order."""
    fields = [c.alias(f"_{i}") for i, c in enumerate(order)]
    keyed = rows.withColumn("_key", F.struct(*fields, F.monotonically_increasing_id().alias("_tie")))
    placed = written(
        keyed.repartitionByRange("_key")
        .sortWithinPartitions("_key")
        .withColumn("_id", F.monotonically_increasing_id())
        .drop("_key"),
        name,
    )
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    before = written(before, f"{name}-parts")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("place", F.col("_before") + inside)
        .drop("_part", "_before", "_id")
    )


def _rolled_up(nodes: DataFrame, done: int, name: str) -> DataFrame:
    """One row per block: tree, block, levels, hash, children.

    ``nodes`` has tree, rank, levels (of the whole tree), hash and payload;
    ``done`` levels are below them.
    """
    keys = ["tree", "block", "levels"]
    digits = [f"_d{k}" for k in range(DIGITS)]
    rank = F.col("rank")
    rows = nodes.select(
        "tree",
        F.floor(rank / FAN**DIGITS).alias("block"),
        "levels",
        "hash",
        "payload",
        *[(F.floor(rank / FAN**k) % FAN).cast("int").alias(d) for k, d in enumerate(digits)],
    ).repartition("tree", "block")
    inner = ["payload"]
    for k, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("digit"), "hash", *inner)
        rows = rows.groupBy(*keys, *digits[k + 1 :]).agg(
            F.array_sort(F.collect_list(child)).alias("children")
        )
        joined = digest(F.array_join(F.col("children.hash"), ""))
        grouped = F.col("levels") > done + k
        rows = rows.withColumn("hash", F.when(grouped, joined).otherwise(F.get("children.hash", F.lit(0))))
        inner = ["children"]
    return written(rows, name)


def _spread(blocks: DataFrame, done: int) -> DataFrame:
    """One row per node of the blocks, with the steps from it to the root.

    ``blocks`` has ``path``, the steps above each block; other columns stay.
    """

    def below(children: Column, k: int, path: Column) -> Column:
        def of(child: Column, i: Column) -> Column:
            def digests(some: Column) -> Column:
                return F.array_join(F.transform(some, lambda c: c["hash"]), "")

            step = F.struct(
                digests(F.slice(children, F.lit(1), i)).alias("left"),
                digests(F.slice(children, i + 2, F.lit(FAN))).alias("right"),
            )
            above = F.when(F.col("levels") > done + k, F.concat(F.array(step), path)).otherwise(path)
            if k == 0:
                return F.array(
                    F.struct(child["hash"].alias("hash"), child["payload"].alias("payload"), above.alias("path"))
                )
            return below(child["children"], k - 1, above)

        return F.flatten(F.transform(children, of))

    kept = [c for c in blocks.columns if c not in ("block", "levels", "hash", "children", "path")]
    nodes = F.explode(below(F.col("children"), DIGITS - 1, F.col("path"))).alias("node")
    return blocks.select(*kept, nodes).select(*kept, "node.*")


def _with_paths(nodes: DataFrame, levels: int, tops: DataFrame | None, name: str) -> DataFrame:
    """The nodes of many trees with ``path`` to the root, and ``root`` of their tree.

    ``levels``: of the highest tree.  ``tops``, if given, makes of the roots of
    the trees (tree, root) a table with the steps above them (tree, path, ...).
    """
    rounds = max(1, -(-levels // DIGITS))
    tables = []
    for k in range(rounds):
        tables.append(_rolled_up(nodes, k * DIGITS, f"{name}-blocks"))
        number = F.struct(F.col("block").alias("number"))
        nodes = tables[-1].select("tree", F.col("block").alias("rank"), "levels", "hash", number.alias("payload"))
    roots = tables[-1].select("tree", F.col("hash").alias("root"))
    above = tops(roots) if tops else roots.withColumn("path", F.array().cast(f"array<{STEP}>"))
    found = _spread(tables[-1].join(above, "tree"), (rounds - 1) * DIGITS)
    for k in range(rounds - 2, -1, -1):
        steps = found.drop("hash").withColumn("block", F.col("payload.number")).drop("payload")
        found = _spread(tables[k].join(steps, ["tree", "block"]), k * DIGITS)
    return found


def _highest(trees: DataFrame) -> int:
    return trees.agg(F.max("levels")).first()[0] or 0


def proofs(
    rows: DataFrame, *, leaf: str, doc_id: str = "doc_id", group: str = "source", keep: Sequence[str] = ()
) -> DataFrame:
    """doc_id, group, leaf, the columns in ``keep``, subroot, root, path of every row.

    ``leaf`` names the column with the digests.
    """
    need(rows, leaf, doc_id, group, *keep)
    payload = F.struct(F.col(doc_id).alias(doc_id), *[F.col(c) for c in keep])
    leaves = written(
        rows.select(F.col(group).alias("group"), F.col(leaf).alias("hash"), payload.alias("payload")),
        "leaves",
    )
    place = [F.col("group"), F.col("payload")[doc_id], F.col("hash")]
    placed = _placed(leaves, place, "placed-leaves")
    groups = written(
        placed.groupBy("group").agg(F.min("place").alias("_first"), F.count("*").alias("_rows")), "groups"
    )
    groups = _placed(groups, [F.col("group")], "placed-groups").withColumnRenamed("place", "tree")
    groups = written(groups.withColumn("levels", _levels(F.col("_rows"))), "trees")

    def above(roots: DataFrame) -> DataFrame:
        """Steps from the roots of the groups to the root of all."""
        total = groups.agg(F.count("*").alias("n")).select(_levels(F.col("n")).alias("levels"))
        levels = total.first()[0]
        named = groups.select("tree", "group")
        nodes = roots.join(named, "tree").select(
            F.lit(0).cast("long").alias("tree"),
            F.col("tree").alias("rank"),
            F.lit(levels).alias("levels"),
            F.col("root").alias("hash"),
            F.struct(F.col("tree").alias("number"), "group").alias("payload"),
        )
        found = _with_paths(nodes, levels, None, "groups")
        return found.select(
            F.col("payload.number").alias("tree"), F.col("payload.group").alias("group"),
            F.col("hash").alias("subroot"), "root", "path",
        )

    nodes = placed.join(groups, placed["group"].eqNullSafe(groups["group"])).select(
        "tree", (F.col("place") - F.col("_first")).alias("rank"), "levels", "hash", "payload"
    )
    found = _with_paths(nodes, _highest(groups), above, "leaves")
    return found.select(
        F.col("payload")[doc_id].alias(doc_id),
        F.col("group").alias(group),
        F.col("hash").alias(leaf),
        *[F.col("payload")[c].alias(c) for c in keep],
        "subroot",
        "root",
        "path",
    )
