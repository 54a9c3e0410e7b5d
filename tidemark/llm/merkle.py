"""Merkle manifest of a dataset with a witness for every row, built by incremental witnesses.

Rows are leaves; those of a group are ordered, and every ``ARITY`` consecutive nodes become their hash until one is left,
the group's root; group roots are the leaves of the last tree. Leaves are dealt in aligned blocks of ``ARITY ** LEVELS``.
Within a block they are appended one by one: the open subtrees hold their nodes, and when a node's siblings are complete
it is given them as its part of the witness. Block roots are appended in the same way to blocks of their own, and so on
up to the root; on the way down each block's rows are joined with the witness of their block's root. So no task holds
more than a block, however large a group is, and of a group only its root goes on.

Positions come from one sort by group, order and leaf dealt over tasks by range: rows are numbered within their range
and begin after the counts of the ranges before, one row for each group and range.

Null groups and null orders are first. Rows of equal order stand by their leaf, equal rows follow one another. A lone
leaf is its group's root and a lone group's root is the root; an empty table gives no rows. The row's own columns travel
as one struct, so that no name clashes. Texts of any length are hashed whole and do not travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import Scratch, cut

ARITY, LEVELS = 3, 6
WITNESS = "array<struct<place:int,siblings:array<string>>>"
_ARROW_WITNESS = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def digest(*values: Column | str) -> Column:
    """Lower-case hex SHA-256 of the values' bytes (UTF-8 byte count, a colon and the value; a dash for null) in turn."""
    text = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Node:
    """A subtree: its hash and, once its siblings are complete, its parent, its place and theirs."""

    __slots__ = ("hash", "parent", "place", "siblings")

    def __init__(self, hash: str):
        self.hash, self.parent, self.place, self.siblings = hash, None, 0, None


class Block:
    """The open subtrees of one block, to which leaves are appended."""

    def __init__(self, arity: int, levels: int):
        self.arity, self.levels, self.leaves = arity, levels, []
        self.open: list[list[Node]] = [[] for _ in range(levels + 1)]

    def append(self, leaf: str) -> None:
        self.leaves.append(node := Node(leaf))
        self._push(0, node)

    def _push(self, level: int, node: Node) -> None:
        self.open[level].append(node)
        if level < self.levels and len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Node(joined([n.hash for n in run]))
        for k, node in enumerate(run):
            node.parent, node.place, node.siblings = parent, k, [n.hash for n in run if n is not node]
        self._push(level + 1, parent)

    def seal(self, whole: bool) -> str:
        """Completes what is open and returns the root. ``whole``: the block is a group by itself, so its tree ends
        with a single node; another's goes up all levels."""
        for level in range(self.levels):
            if whole and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                return self.open[level][0].hash
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0].hash

    def witnesses(self) -> list[list[dict]]:
        out = []
        for leaf in self.leaves:
            steps, node = [], leaf
            while node.parent is not None:
                steps.append({"place": node.place, "siblings": node.siblings})
                node = node.parent
            out.append(steps)
        return out


def _sealed(batches: Iterator[pa.RecordBatch], arity: int, levels: int) -> Iterator[tuple[pa.RecordBatch | None, list[tuple[str, int, Block, str]]]]:
    """Each batch of (grp, block, n, hash, ...), in order, with the blocks that ended since the last one."""
    held, key = None, None
    for batch in batches:
        ended = []
        if batch.num_rows:
            grp, block, n, leaf = (batch.column(k) for k in range(4))
            number = np.asarray(block)
            code = np.asarray(grp.dictionary_encode().indices)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(number) != 0) | (np.diff(code) != 0)) + 1, [batch.num_rows])).tolist()
            leaves = leaf.to_pylist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = (grp[a].as_py(), int(number[a]))
                if at != key:
                    if held is not None:
                        ended.append((*key, held, held.seal(whole)))
                    held, key, whole = Block(arity, levels), at, n[a].as_py() <= arity**levels
                for x in leaves[a:b]:
                    held.append(x)
        yield batch, ended
    if held is not None:
        yield None, [(*key, held, held.seal(whole))]


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "position")


def _roots(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """grp, position, n, hash of the block roots: the nodes one tier up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ended in _sealed(batches, arity, levels):
            if ended:
                grp, block, _, root = zip(*ended)
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(block, pa.int64()), pa.array(root, pa.string())], names=["grp", "position", "hash"])

    size = arity**levels
    found = _dealt(nodes).select("grp", "block", "n", "hash").mapInArrow(run, "grp string, position long, hash string")
    blocks = nodes.where(F.col("position") % size == 0).select("grp", F.col("block").alias("position"), F.ceil(F.col("n") / size).alias("n"))
    return found.join(blocks, ["grp", "position"]).withColumn("block", F.floor(F.col("position") / size))


def _witnessed(nodes: DataFrame, above: DataFrame, arity: int, levels: int) -> DataFrame:
    """The nodes with the witness up to the root; above: grp, position, witness, root, subroot of their blocks' roots."""
    above = above.select("grp", F.col("position").alias("block"), F.col("witness").alias("above"), "subroot", "root")
    rows = nodes.repartition("grp", "block").join(above, ["grp", "block"]).sortWithinPartitions("grp", "block", "position")
    rows = rows.select("grp", "block", "n", "hash", *(c for c in rows.columns if c not in ("grp", "block", "n", "hash")))
    names = [*rows.columns, "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, found = [], []
        for batch, ended in _sealed(batches, arity, levels):
            if batch is not None:
                waiting.append(batch)
            for _, _, block, _ in ended:
                found += block.witnesses()
            while waiting and len(found) >= waiting[0].num_rows:
                rows = waiting.pop(0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found[: rows.num_rows], _ARROW_WITNESS)], names=names)
                found = found[rows.num_rows :]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"own {WITNESS}"])
    return rows.mapInArrow(run, schema).withColumn("witness", F.concat("own", "above")).drop("own", "above", "block")


def _numbered(rows: DataFrame, scratch: Scratch, order: list[str], size: int) -> DataFrame:
    """Rows with their position from 0 within grp, the number n of the group's rows and the block that they fall in."""
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()) % 4096)  # equal rows are no hot key
    ranges = scratch.cut(salted.repartitionByRange("grp", *order, "salt").withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("grp", "range").agg(F.count("*").alias("rows"))
    every = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("grp", "range", before.alias("before"), F.sum("rows").over(every).alias("n"))
    own = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*order, "salt")) - 1
    placed = ranges.withColumn("own", own).join(counts, ["grp", "range"]).withColumn("position", F.col("own") + F.col("before"))
    return scratch.cut(placed.withColumn("block", F.floor(F.col("position") / size)).drop("own", "before", "range", "salt"))


def _tree(nodes: DataFrame, scratch: Scratch, arity: int, levels: int) -> list[DataFrame]:
    """The tiers of nodes from the leaves to the groups' roots (the last has one node a group)."""
    tiers, most = [nodes], nodes.agg(F.max("n")).first()[0]
    while most > 1:
        tiers.append(scratch.cut(_roots(tiers[-1], arity, levels)))
        most = -(-most // arity**levels)
    return tiers


def manifest(rows: DataFrame, leaf: str, group: str, order: str, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """row (a struct of all given columns), leaf, subroot, root, and witness: for each level from the leaf to the root
    its place among its siblings and theirs in order."""
    size = arity**levels
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    with Scratch(rows.sparkSession) as scratch:
        leaves = rows.select(key.alias("grp"), F.col(order).alias("at"), F.col(leaf).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
        nodes = _numbered(leaves, scratch, ["at", "hash"], size).drop("at")
        if nodes.isEmpty():
            return rows.sparkSession.createDataFrame([], leaves.select("row", F.lit("").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit(None).cast(WITNESS).alias("witness")).schema)
        groups = _tree(nodes, scratch, arity, levels)
        tops = groups[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
        forest = _tree(_numbered(tops, scratch, ["name"], size), scratch, arity, levels)
        nothing = F.lit(None).cast(WITNESS)
        above = forest[-1].select("grp", "position", F.coalesce(nothing, F.array().cast(WITNESS)).alias("witness"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
        for tier in forest[-2::-1]:
            above = scratch.cut(_witnessed(tier, above, arity, levels))
        above = above if "name" in above.columns else forest[0].join(above.drop("position"), "grp")
        above = above.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("position"), "witness", F.col("hash").alias("subroot"), "root")
        for tier in groups[-2:0:-1]:
            above = scratch.cut(_witnessed(tier, above, arity, levels))
        if len(groups) > 1:
            found = _witnessed(groups[0], above, arity, levels)
        else:
            found = groups[0].join(above.drop("position"), "grp")
        return cut(found.select("row", F.col("hash").alias("leaf"), "subroot", "root", "witness"))


def proof_hash(witness: Column) -> Column:
    """Hash of all siblings of a witness, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(witness, lambda w: w["siblings"])), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""

    def up(h: Column, w: Column) -> Column:
        left, right = F.slice(w["siblings"], F.lit(1), w["place"]), F.slice(w["siblings"], w["place"] + 1, F.size(w["siblings"]))
        return F.sha2(F.concat(F.array_join(left, ""), h, F.array_join(right, "")), 256)

    return F.aggregate(witness, leaf, up)
