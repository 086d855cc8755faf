"""Exact nearest points by a balanced partition of space.

Space is halved at medians of a bounded sample until a leaf holds about
:data:`LEAF` points, up to :data:`FAN` leaves a pass, so a pass plans with a
small tree per node and a few passes serve any number of points. Medians keep
leaves even whatever the distribution; one outlier does not stretch them. A
point's nearest ones in its own leaf bound its search, and it then visits the
leaves that its ball reaches. Leaves are compared as blocks inside tasks; what
meets a node is dealt into parts of bounded size first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestat.columns import ref
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on

#: Points of a leaf, leaves that one pass makes of a node, and sampled points for each of them.
LEAF, FAN, SAMPLED = 256, 1_024, 16
#: Points that a task routes or searches at once, and passes at most.
PART, PASSES = 16_384, 6
#: Distances that a task holds at once.
HELD = 1 << 21

TREE = "axes array<int>, cuts array<double>, low array<int>, high array<int>"


def split_tree(points: np.ndarray, leaves: int) -> dict[str, list]:
    """Inner nodes of a tree over the points: axis, cut and both children.

    A child of -1 - k is leaf k. A point goes high where its value reaches the cut.
    """
    tree: dict[str, list] = {"axes": [], "cuts": [], "low": [], "high": []}
    made = 0

    def cut_of(block: np.ndarray) -> tuple[int, float] | None:
        best, chosen = (0.0, -1.0), None
        for axis in range(block.shape[1]):
            column = np.sort(block[:, axis])
            cut = column[len(column) // 2]
            if cut == column[0]:
                above = np.searchsorted(column, cut, "right")
                if above == len(column):
                    continue
                cut = column[above]
            below = np.searchsorted(column, cut) / len(column)
            spread = column[len(column) * 7 // 8] - column[len(column) // 8]
            rank = (min(below, 1 - below, 0.25), spread)
            if rank > best:
                best, chosen = rank, (axis, float(cut))
        return chosen

    def grow(block: np.ndarray, wanted: int) -> int:
        nonlocal made
        found = cut_of(block) if wanted > 1 and len(block) > 1 else None
        if found is None:
            made += 1
            return -made
        axis, cut = found
        at = len(tree["axes"])
        for name, value in zip(tree, (axis, cut, 0, 0)):
            tree[name].append(value)
        above = block[:, axis] >= cut
        for name, part, share in (("low", block[~above], wanted - wanted // 2), ("high", block[above], wanted // 2)):
            tree[name][at] = grow(part, share)
        return at

    grow(points, leaves)
    return tree


def arrays_of(tree: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(tree[c][0].as_py(), dtype=t) for c, t in (("axes", int), ("cuts", float), ("low", int), ("high", int)))


def vectors_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """rows x dim matrix of an array column."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def as_lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def descend(tree: tuple[np.ndarray, ...], v: np.ndarray) -> np.ndarray:
    """Leaf of every point."""
    axes, cuts, low, high = tree
    at = np.zeros(len(v), dtype=int) if len(axes) else np.full(len(v), -1)
    while (moving := np.flatnonzero(at >= 0)).size:
        node = at[moving]
        at[moving] = np.where(v[moving, axes[node]] >= cuts[node], high[node], low[node])
    return -1 - at


def reached(tree: tuple[np.ndarray, ...], v: np.ndarray, off: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, off) of the leaves within the radius of each point.

    ``off`` is how far the region lies from the point along each axis.
    """
    axes, cuts, low, high = tree
    row, at = np.arange(len(v)), np.full(len(v), 0 if len(axes) else -1)
    done = [(row[:0], row[:0], off[:0])]
    while len(row):
        ended = at < 0
        done.append((row[ended], -1 - at[ended], off[ended]))
        row, at, off = row[~ended], at[~ended], off[~ended]
        if not len(row):
            break
        axis = axes[at]
        gap = v[row, axis] - cuts[at]
        home, other = np.where(gap >= 0, high[at], low[at]), np.where(gap >= 0, low[at], high[at])
        far = off.copy()
        far[np.arange(len(row)), axis] = np.maximum(np.abs(gap), off[np.arange(len(row)), axis])
        near = np.sqrt((far * far).sum(axis=1)) <= radius[row]
        row, at, off = np.concatenate([row, row[near]]), np.concatenate([home, other[near]]), np.concatenate([off, far[near]])
    return tuple(np.concatenate(c) for c in zip(*done))


def closest(v: np.ndarray, radius: np.ndarray, points: np.ndarray, starts: np.ndarray, times: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """(row, d, j): the ``keep`` smallest positive (distance, time) of every row of ``v`` within its radius."""
    found = []
    step = max(1, HELD // max(len(points), 1))
    for begin in range(0, len(v), step):
        block = v[begin : begin + step]
        squares = (block[:, :1] - points[:, 0][None, :]) ** 2
        for k in range(1, points.shape[1]):
            squares += (block[:, k : k + 1] - points[:, k][None, :]) ** 2
        d = np.sqrt(squares, out=squares)
        d[d == 0] = np.inf
        limit = np.minimum(radius[begin : begin + len(block)], np.finfo(float).max)
        if len(points) > keep:
            limit = np.minimum(limit, np.partition(d, keep - 1, axis=1)[:, keep - 1])
        row, at = np.nonzero(d <= limit[:, None])
        size = starts[at + 1] - starts[at]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        gap, j, row = np.repeat(d[row, at], size), times[np.repeat(starts[at], size) + inner], np.repeat(row, size)
        order = np.lexsort((j, gap, row))
        row, gap, j = row[order], gap[order], j[order]
        first = np.searchsorted(row, row)
        few = np.arange(len(row)) - first < keep
        found.append((row[few] + begin, gap[few], j[few]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))


def met(df: DataFrame, other: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, pa.Table], tuple[np.ndarray, dict]], carried: Sequence[str], made: str) -> DataFrame:
    """What ``run`` makes of the rows that lie in a node and the other side's table of that node.

    ``run`` gives row numbers and new columns; keys, id and ``carried`` are
    taken along. The rows of a node are dealt into parts of bounded size, for
    each of which the other side, which is small, is repeated.
    """
    at = [*keys, "node"]
    parts = F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int")
    sizes = stored(df.groupBy(*[ref(c) for c in at]).agg(parts.alias("parts")))
    left = join_on(df, sizes, at).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    right = join_on(other, sizes, at).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # Both sides may come from one table: the other one's columns get names of their own.
    right = right.select(*[ref(c).alias(c) for c in right.columns])
    along = [*keys, "id", *carried]

    def cogrouped(rows: pa.Table, table: pa.Table) -> pa.Table:
        index, columns = run(rows, table)
        return pa.table({**{c: rows[c].take(pa.array(index, pa.int64())) for c in along}, **columns})

    fields = [df.schema[c] for c in along]
    by = [*[ref(c) for c in at], "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(cogrouped, StructType([*fields, *StructType.fromDDL(made).fields]))


def planted(points: DataFrame, keys: Sequence[str], dim: int, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their leaf as ``node``, and the trees of every pass: (keys, node, axes, cuts, low, high)."""
    at = [*keys, "node"]
    at_cols = [ref(c) for c in at]
    placed, trees = points.withColumn("node", F.lit(0).cast("long")), []

    def grown(sample: pa.Table) -> pa.Table:
        tree = split_tree(vectors_of(sample["v"], dim), sample["leaves"][0].as_py())
        types = (pa.int32(), pa.float64(), pa.int32(), pa.int32())
        return pa.table({**{c: sample[c].slice(0, 1) for c in at}, **{c: pa.array([v], pa.list_(t)) for (c, v), t in zip(tree.items(), types)}})

    def routed(rows: pa.Table, table: pa.Table) -> tuple[np.ndarray, dict]:
        leaves = descend(arrays_of(table), vectors_of(rows["v"], dim))
        return np.arange(len(leaves)), {"node": pa.array(rows["node"].to_numpy() * FAN + leaves, pa.int64())}

    while len(trees) < PASSES:
        leaves = F.when(F.col("size") > 4 * leaf, F.least(F.ceil(F.col("size") / leaf), F.lit(FAN))).otherwise(F.lit(1)).cast("int")
        sizes = stored(placed.groupBy(*at_cols).agg(F.count(F.lit(1)).alias("size")).withColumn("leaves", leaves))
        if not sizes.where("leaves > 1").limit(1).count():
            break
        turn = F.pmod(F.xxhash64("id", F.lit(len(trees))), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = turn < F.col("leaves") * SAMPLED / F.col("size")
        sample = join_on(placed.select(*at_cols, "id", "v"), sizes.where("leaves > 1"), at).where(drawn).select(*at_cols, "v", "leaves")
        schema = StructType([*[placed.schema[c] for c in at], *StructType.fromDDL(TREE).fields])
        grew = join_on(sizes.select(*at_cols), sample.groupBy(*at_cols).applyInArrow(grown, schema), at, "left")
        kinds = [f.split(" ", 1) for f in TREE.split(", ")]
        trees.append(stored(grew.select(*at_cols, *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in kinds])))
        placed = stored(met(placed, trees[-1], keys, routed, ["v", "times"], "node long"))
    return placed, trees


def nearest_points(points: DataFrame, keys: Sequence[str], dim: int, keep: int) -> DataFrame:
    """(keys, id, near): the ``keep`` smallest (d, j) of every point, sorted, where other points lie at a distance d > 0.

    ``points`` has keys, id (unique by keys), v (different vectors of ``dim``
    values) and times (sorted, at most ``keep``), whose members are the j.
    Distances are compared exactly, equal ones by j.
    """
    key_cols = [ref(k) for k in keys]
    leaf = max(LEAF, 4 * keep)
    placed, trees = planted(points, keys, dim, leaf)

    def searched(rows: pa.Table, table: pa.Table) -> tuple[np.ndarray, dict]:
        v, radius = vectors_of(rows["v"], dim), rows["radius"].to_numpy()
        times = table["times"].combine_chunks()
        starts = np.concatenate([[0], np.cumsum(times.value_lengths().to_numpy())]).astype(np.int64)
        row, d, j = closest(v, radius, vectors_of(table["v"], dim), starts, times.flatten().to_numpy(), keep)
        few = pa.array(np.searchsorted(row, np.arange(len(v) + 1)), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(j, pa.int64())], ["d", "j"])
        return np.arange(len(v)), {"near": pa.ListArray.from_arrays(few, pairs)}

    def visited(rows: pa.Table, table: pa.Table) -> tuple[np.ndarray, dict]:
        tree = arrays_of(table)
        # A hair more than the radius, so that rounding never loses a neighbour.
        row, child, off = reached(tree, vectors_of(rows["v"], dim), vectors_of(rows["off"], dim), rows["radius"].to_numpy() * (1 + 1e-9))
        return row, {"node": pa.array(rows["node"].to_numpy()[row] * FAN + child, pa.int64()), "off": as_lists(off)}

    pairs = "near array<struct<d: double, j: long>>"
    blocks = placed.select(*key_cols, "node", "v", "times")
    queries = placed.select(*key_cols, "node", "id", "v", F.col("node").alias("home"), F.lit(float("inf")).alias("radius"))
    own = met(queries, blocks, keys, searched, ["v", "home"], pairs)
    if not trees:
        return own.select(*key_cols, "id", "near")
    own = stored(own.withColumn("radius", F.when(F.size("near") >= keep, F.col("near")[keep - 1]["d"]).otherwise(F.lit(float("inf")))))
    visits = own.select(*key_cols, F.lit(0).cast("long").alias("node"), "id", "v", "home", "radius", F.array(*[F.lit(0.0)] * dim).alias("off"))
    for tree in trees:
        visits = stored(met(visits, tree, keys, visited, ["v", "home", "radius"], "node long, off array<double>"))
    others = met(visits.where("node != home").drop("off"), blocks, keys, searched, [], pairs)
    both = own.select(*key_cols, "id", "near").unionByName(others.where(F.size("near") > 0))
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, keep)
    return both.groupBy(*key_cols, "id").agg(merged.alias("near"))
