"""Groups of linked items: connected components, and exact comparison inside candidate groups in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.scratch import Scratch

#: Items of a block; larger groups are compared block by block.
BLOCK = 512
#: (columns, starts of groups, block of each row) -> index pairs that match; groups are runs of rows.
Matcher = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is one node of its component, the same for all of them.

    Each round hooks every node to the least of its neighbours and that one's, and contracts the edges to what is still
    apart; so a round costs what is left, and all rounds together little more than the first. Nodes should be hashes,
    whose order makes each round shrink by a factor. The rounds, each written out, are then applied one after the other.
    Hot nodes meet only joins of written tables, whose large partitions adaptive execution splits.
    """
    both = scratch.store(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    rounds = []
    while True:
        hooked = scratch.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        step = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        rounds.append(scratch.store(hooked.join(step, "root").select("node", F.col("next").alias("root"))))
        left, right = (rounds[-1].select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        moved = both.join(left, "a").join(right, "b").where("a_root != b_root")
        apart = scratch.store(moved.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
        scratch.drop(both, hooked)
        if apart.isEmpty():
            break
        both = apart
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = rounds.pop().join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.store(out)


def least_index(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each of n items' component under the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(match: Matcher, gather: str):
    def run(table: pa.Table) -> pa.Table:
        known = pd.DataFrame({"grp": table["grp"].to_pylist(), "key": table["key"].to_pylist()})
        table = table.filter(pa.array(~known.duplicated().to_numpy()))
        group = pd.factorize(known["grp"][~known.duplicated()])[0]
        block = table["blk"].to_numpy()
        order = np.lexsort((block, group))
        table, group, block = table.take(pa.array(order)), group[order], block[order]
        starts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        columns = {c: table[c].combine_chunks() for c in table.column_names}
        a, b = match(columns, starts, block)
        n, keys = table.num_rows, table["key"].to_pylist()
        low = table["low"][0].as_py()
        if low != table["high"][0].as_py():  # two blocks: pairs inside either are compared elsewhere
            cross = block[a] != block[b]
            a, b = a[cross], b[cross]
        root = least_index(n, a, b)
        moved = np.flatnonzero(root != np.arange(n))
        rows = [(keys[i], keys[root[i]], 0) for i in moved]
        if gather == "earliest" and n:
            places = np.array(table["place"].to_pylist(), object)
            rank = np.empty(n, np.int64)
            rank[np.argsort(places, kind="stable")] = np.arange(n)
            first = rank.copy()
            np.minimum.at(first, a, rank[b])
            np.minimum.at(first, b, rank[a])
            by_rank = np.sort(places, kind="stable")
            rows = [(keys[i], by_rank[first[i]], 0) for i in np.flatnonzero(first < rank)]
        if gather == "links":
            weight = table["n"].to_numpy()
            links = np.bincount(a, weights=weight[b], minlength=n) + np.bincount(b, weights=weight[a], minlength=n)
            rows += [(keys[i], None, int(links[i])) for i in np.flatnonzero(links)]
        x, y, z = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.Table.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(z, pa.int64())], ["a", "b", "links"])

    return run


def compare_in_groups(rows: DataFrame, match: Matcher, scratch: Scratch, gather: str = "links", useful: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Compare the items of each group; rows has grp, key (binary) and what `match` reads.

    Returns written rows, linear in the items however many pairs match: (a, b, 0) says that a and b are in one
    component. Gathering 'links', which needs n (copies of the item), adds rows (a, null, links) whose sum is the links
    of item a. Gathering 'earliest', which needs place (binary), returns (a, place, 0) alone: the least place of an item
    that matches a, where it is less than a's own. `rows` should be a written table. Groups for which the aggregate
    `useful` is false are left out.

    Groups of up to `block` items are compared many at a time; larger ones are cut into blocks by a hash of the key and
    each pair of blocks is a task's work, so no group meets in one task.
    """
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"), (F.lit(True) if useful is None else useful).alias("useful"))
    sizes = scratch.store(sizes.where("size > 1 and useful").drop("useful"))
    items = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    bins = max(1, -(-items // (4 * block)))
    placed = rows.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("size") / block))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    placed = placed.withColumn("other", other).withColumns({"low": F.least("blk", "other"), "high": F.greatest("blk", "other")})
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.xxhash64("grp"))
    placed = placed.withColumn("deal", deal).drop("size", "other", "blocks")
    out = placed.groupBy("deal", "low", "high").applyInArrow(_compare(match, gather), "a binary, b binary, links long")
    out = scratch.store(out)
    scratch.drop(sizes)
    return out


def resolve(compared: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, links, root) of every item that links with another one."""
    roots = components(compared.where("b is not null"), scratch)
    links = compared.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    return scratch.store(links.join(roots.withColumnRenamed("node", "key"), "key"))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right]; each set is an array of distinct values."""
    both = np.concatenate([left, right])
    sizes = np.array([len(sets[i]) for i in both])
    values, at = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True)
    row = np.repeat(np.arange(len(both)), sizes)
    # values on one side only cannot meet
    is_left = row < len(left)
    shared = np.zeros((2, len(values)), bool)
    shared[0, at[is_left]] = True
    shared[1, at[~is_left]] = True
    use = np.cumsum(shared.all(axis=0)) - 1
    keep = shared.all(axis=0)[at]
    row, at = row[keep], use[at[keep]]
    width = int(use[-1]) + 1 if len(use) else 0
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, width, chunk):
        a, b = np.searchsorted(at, [low, low + chunk])
        dense = np.zeros((len(both), min(chunk, width - low)), np.float32)
        dense[row[a:b], at[a:b] - low] = 1
        total += dense[: len(left)] @ dense[len(left) :].T
    return total
