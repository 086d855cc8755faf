"""Merkle trees over the rows of a dataset, kept as postorder logs, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.scratch import Scratch

#: Leaves of one builder, as a power of two.
BUILDER = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PART = 33  # bits of the row number inside a partition in monotonically_increasing_id


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def subtree_size(leaves: int, height: int) -> int:
    """Nodes of the lowest `height` + 1 levels over so many leaves; the last run of a level may be short."""
    return sum((leaves + (1 << k) - 1) >> k for k in range(height + 1))


def height_of(leaves: int) -> int:
    """Levels above the leaves, up to the one with a single node."""
    return max(0, (leaves - 1).bit_length())


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree with so many leaves.

    All that lies left of its first leaf f is complete and was written before: 2 * f - popcount(f) nodes. Then follow the
    nodes below it, whose number is the size of its subtree, and itself.
    """
    f = index << level
    return 2 * f - f.bit_count() + subtree_size(min(1 << level, leaves - f), level) - 1


def append_log(leaves: list[str], height: int) -> list[str]:
    """Nodes of an aligned subtree in order of completion; every two siblings, or a last one alone, make a node."""
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(height + 1)]

    def write(digest: str, level: int, last: bool) -> None:
        log.append(digest)
        if level == height:
            return
        run = open_nodes[level]
        run.append(digest)
        if len(run) == 2 or last:
            parent = hashlib.sha256("".join(run).encode()).hexdigest()
            run.clear()
            write(parent, level + 1, last)

    for i, leaf in enumerate(leaves):
        write(leaf, 0, i == len(leaves) - 1)
    return log


def _built_height(total: int, bits: int) -> int:
    """Levels that a builder adds: to the root where it holds the whole tree, else as many as all aligned builders."""
    return height_of(total) if total <= 1 << bits else bits


_LOG = "tree string, block long, total long, leaves int, log array<string>"


def _build(bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total = table["total"][0].as_py()
        log = append_log(table["digest"].to_pylist(), _built_height(total, bits))
        row = {"tree": [table["tree"][0].as_py()], "block": [table["place"][0].as_py() >> bits], "total": [total], "leaves": [table.num_rows], "log": [log]}
        types = {"tree": pa.string(), "block": pa.int64(), "total": pa.int64(), "leaves": pa.int32(), "log": pa.list_(pa.string())}
        return pa.table({c: pa.array(v, types[c]) for c, v in row.items()})

    return run


def _paths(bits: int):
    """The siblings of each node: those inside the builder, found in its log, then those above it."""

    def run(nodes: pa.Table, logs: pa.Table) -> pa.Table:
        log, leaves = logs["log"][0].as_py(), logs["leaves"][0].as_py()
        above = logs["path"][0].as_py()
        height = _built_height(logs["total"][0].as_py(), bits)
        inside: dict[tuple[int, int], str] = {}
        for level in range(height):
            many = (leaves + (1 << level) - 1) >> level
            for index in range(many):
                other = index ^ 1
                inside[level, index] = "RL"[index & 1] + log[position(level, other, leaves)] if other < many else ""
        out = []
        for place in nodes["place"].to_pylist():
            own = place & ((1 << bits) - 1)
            out.append([inside[level, own >> level] for level in range(height)] + above)
        return nodes.drop_columns(["block"]).append_column("path", pa.array(out, pa.list_(pa.string())))

    return run


def _numbered(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Leaves (a written table with tree) with place (by `order` within the tree, from 0) and total (leaves of the tree).

    Rows are sorted into ranges; a row's number inside its partition comes with the sort, and the rows of the same tree
    in earlier partitions are added from a table with one line for each tree and partition.
    """
    keys = ["tree", *order]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = scratch.store(ranged)
    part = F.shiftright("at", _PART)
    counts = ranged.groupBy("tree", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    trees = Window.partitionBy("tree")
    before = F.sum("n").over(trees.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.select("tree", "part", (before - F.col("first")).alias("move"), F.sum("n").over(trees).alias("total"))
    out = ranged.withColumn("part", part).join(counts, ["tree", "part"])
    return scratch.store(out.withColumn("place", F.col("at") + F.col("move")).drop("at", "move", "part"))


def _grow(leaves: DataFrame, bits: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of nodes (tree, place, total, digest), the leaves first, and the logs that builders wrote over each of them."""
    most = leaves.agg(F.max("total").alias("n")).first()["n"] or 0
    nodes, logs = [leaves], []
    while True:
        block = F.shiftright("place", bits).alias("block")
        work = nodes[-1].select("tree", "place", "total", "digest").groupBy("tree", block).applyInArrow(_build(bits), _LOG)
        logs.append(scratch.store(work))
        most = -(-most >> bits)
        if most <= 1:
            return nodes, logs
        more = logs[-1].where(F.col("total") > (1 << bits))
        total = F.shiftright(F.col("total") + ((1 << bits) - 1), bits)
        nodes.append(more.select("tree", F.col("block").alias("place"), total.alias("total"), F.element_at("log", -1).alias("digest")))


def _roots(logs: list[DataFrame], bits: int) -> DataFrame:
    """(tree, digest): the last node of the log of the builder that holds the rest of the tree."""
    done = [log.where(F.col("total") <= (1 << bits)).select("tree", F.element_at("log", -1).alias("digest")) for log in logs]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _with_paths(nodes: list[DataFrame], logs: list[DataFrame], above: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """The leaves with path; `above` (tree, path) is what lies over the roots. From the top round down."""
    upper = None
    for node, log in zip(reversed(nodes), reversed(logs), strict=True):
        done = log.where(F.col("total") <= (1 << bits)).join(above, "tree")
        if upper is not None:
            open_ = log.where(F.col("total") > (1 << bits)).join(upper.select("tree", F.col("place").alias("block"), "path"), ["tree", "block"])
            done = done.unionByName(open_)
        work = node.withColumn("block", F.shiftright("place", bits))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in node.schema) + ", path array<string>"
        found = work.groupBy("tree", "block").cogroup(done.groupBy("tree", "block")).applyInArrow(_paths(bits), schema)
        upper = scratch.store(found) if node is not nodes[0] else found
    return upper


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_column: str = "lang", order_column: str = "doc_id", also: Mapping[str, Column] | None = None, builder_bits: int = BUILDER
) -> DataFrame:
    """Leaf, roots and proof of every row.

    A leaf is the sha256 (lowercase hex, like all digests) of the row's `fields`, each encoded as `encoded` says. Rows of
    one value of `tree_column` ascend by `order_column` (null first; ties by leaf, so rows that tie in full are
    interchangeable); while several nodes remain, every two neighbours, or a last one alone, become the hash of their
    digests. The subroots that remain, by tree value (null first, then by UTF-8 bytes), give the root likewise.

    Returns one row per row: the order column, leaf, subroot, root, and path: the siblings from the leaf to the root, a
    string for each level: 'L' or 'R' (its side) and the digest, or '' where the node has none. `folded` and `path_hash`
    read it. `also` adds columns computed from the row. Nulls may stand in any field; a null tree value is a tree of its
    own; the text may be empty or very long and is never shuffled; other columns are ignored. No row: no row.

    Builders take 2 ** builder_bits neighbouring leaves each, aligned, and write their nodes in the order in which they are
    complete; their roots are the leaves of the next round. As runs are aligned, a node's place in such a log has a closed
    form (`position`), by which proofs fetch the siblings, from the top round down. A tree that holds most rows is just
    more builders.
    """
    scratch = Scratch(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_column).cast("string")), F.lit(""))
    extra = [c.alias(f"also_{k}") for k, c in enumerate((also or {}).values())]
    leaves = docs.select(tree.alias("tree"), F.col(order_column).alias("rank"), leaf_hash(*map(F.col, fields)).alias("digest"), F.monotonically_increasing_id().alias("tie"), *extra)
    leaves = _numbered(scratch.store(leaves), ["rank", "digest", "tie"], scratch).drop("tie")
    nodes, logs = _grow(leaves, builder_bits, scratch)
    subroots = scratch.store(_roots(logs, builder_bits))
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = _numbered(scratch.store(top), ["name"], scratch)
    top_nodes, top_logs = _grow(top, builder_bits, scratch)
    root = _roots(top_logs, builder_bits).select(F.col("tree").alias("_top"), F.col("digest").alias("root"))
    nothing = F.array().cast("array<string>")
    top_paths = _with_paths(top_nodes, top_logs, scratch.store(_roots(top_logs, builder_bits)).select("tree", nothing.alias("path")), builder_bits, scratch)
    top_paths = scratch.store(top_paths.join(root, F.col("tree") == F.col("_top")).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    found = _with_paths(nodes, logs, top_paths.select("tree", "path"), builder_bits, scratch)
    found = found.join(top_paths.drop("path"), "tree")
    named = [F.col(f"also_{k}").alias(name) for k, name in enumerate(also or {})]
    return found.select(F.col("rank").alias(order_column), F.col("digest").alias("leaf"), "subroot", "root", "path", *named)


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path give."""

    def step(digest: Column, sibling: Column) -> Column:
        side, other = F.substring(sibling, 1, 1), F.substring(sibling, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(other, digest)).when(side == "R", F.concat(digest, other)).otherwise(digest), 256)

    return F.aggregate(path, leaf, step)


def path_hash(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up; levels without one count nothing."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)
