"""Exact counting of points in boxes, without forming pairs.

Every coordinate of a delay embedding is a value of the same series, so one
dense rank per distinct value serves all dimensions, and "closer than eps"
becomes an integer interval of ranks. Intervals split into dyadic nodes
(``level``, ``rank >> level``): a point lies in exactly one node per level, and
an interval is a disjoint union of at most two nodes per level. Points and
boxes meet by equality of nodes in all dimensions but the last two. In the
first, the nodes that are shuffled consist of blocks of about
:data:`BLOCK_POINTS` points; the rest of an interval, at most two cut blocks, is
split inside the task. The last two are counted there, in a wavelet matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestat.columns import ref
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import broadcast_if, join_on
from lodestat.plans.ordering import with_position
from lodestat.plans.series import Series

#: Points of a block of first ranks, rows of one side that meet in a task, bits of a node's number, mark of a cut block.
BLOCK_POINTS, PART, NODE_BITS, CUT = 32_768, 262_144, 40, 1 << 10
#: Core seconds per row and pair of levels (6e-7 to 7e-7 measured; their shuffle, larger than that of tiles, is the rest).
BOX_LEVEL_SECONDS = 1e-6


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order; its own inverse on the bit patterns."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def far_end(v: np.ndarray, eps: float, sign: int) -> np.ndarray:
    """Per value the nearest double above (sign 1) or below (-1) it whose rounded difference from it reaches eps.

    The rounded difference is monotone, so halving over the doubles finds the end exactly, which v + eps does not.
    """
    v = np.asarray(v, dtype=float) + 0.0
    if not eps > 0:
        return v
    near = _ordered(sign * v)
    far = np.full(len(v), _ordered(np.array([np.inf]))[0])
    with np.errstate(over="ignore", invalid="ignore"):
        while True:
            middle = (near >> 1) + (far >> 1) + (near & far & 1)
            between = (middle > near) & (middle < far)
            if not between.any():
                break
            inside = _ordered(middle.view(np.float64)).view(np.float64) - sign * v < eps
            near, far = np.where(between & inside, middle, near), np.where(between & ~inside, middle, far)
    return np.where(np.isfinite(v), sign * _ordered(far.view(np.float64)).view(np.float64), v)


def value_intervals(series: Series, eps: float) -> DataFrame:
    """Per distinct (keys, x): weight, rank, rank interval and neighbour count.

    ``lo``/``hi`` delimit the ranks of values with abs(difference) < eps and
    ``near`` counts the points among them (itself included). The values and
    both interval ends are ordered together, once.
    """
    keys = series.key_cols()
    counted = series.df.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w"))
    eps = float(eps)

    @F.pandas_udf("low double, high double")
    def ends(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"low": far_end(x.to_numpy(), eps, -1), "high": far_end(x.to_numpy(), eps, 1)})

    counted = counted.withColumn("__ends", ends("x"))
    # Order at equal positions: the ends themselves are outside, so values at a
    # low end come before it and values at a high end after it.
    marks = F.array(
        F.struct(F.lit(1).alias("kind"), F.col("x").alias("at"), F.col("w").alias("w"), F.lit(1).cast("long").alias("one")),
        F.struct(F.lit(2).alias("kind"), F.col("__ends.low").alias("at"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("one")),
        F.struct(F.lit(0).alias("kind"), F.col("__ends.high").alias("at"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("one")),
    )
    events = counted.select(*keys, "x", F.explode(marks).alias("__m")).select(*keys, "x", "__m.*")
    # Both running totals ride in one sum: points in the weight, ranks apart.
    placed = with_position(events, series.keys, ["at", "kind", "x"], weight="w", also="one")
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = placed.groupBy(*keys, "x").agg(
        at(1, "w").alias("w"),
        at(1, "__before_also").alias("rank"),
        at(2, "__before_also").alias("lo"),
        at(0, "__before_also").alias("hi"),
        at(2, "__before").alias("__below"),
        at(0, "__before").alias("__upto"),
    )
    return out.withColumn("near", F.col("__upto") - F.col("__below")).drop("__below", "__upto")


def point_nodes(rank: Column, levels: int) -> Column:
    """The node of a rank on every level, as array of (level, node)."""
    return F.array(*[F.struct(F.lit(l).alias("l"), F.shiftright(rank, l).alias("k")) for l in range(levels + 1)])


def cover_nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Disjoint nodes covering the ranks [lo, hi), as array of (level, node)."""
    nodes = []
    for l in range(levels + 1):
        first = F.shiftright(lo + F.lit((1 << l) - 1), l)
        end = F.shiftright(hi, l)
        node = lambda k, l=l: F.struct(F.lit(l).alias("l"), k.alias("k"))
        nodes.append(F.when((first < end) & (first % 2 == 1), node(first)))
        nodes.append(F.when((first < end) & (end % 2 == 1), node(end - 1)))
    return F.array_compact(F.array(*nodes))


def block_nodes(rank: Column, low: int, levels: int) -> Column:
    """Where a point's first rank lies: its nodes of whole blocks, as array of (node, r), and its block with the rank."""
    spot = lambda level, k, r: F.struct((F.lit(level << NODE_BITS) + k).alias("node"), r.alias("r"))
    whole = [spot(l, F.shiftright(rank, l), F.lit(0).cast("long")) for l in range(low, levels + 1)]
    return F.array(*whole, spot(CUT, F.shiftright(rank, low), rank))


def block_cover(lo: Column, hi: Column, low: int, levels: int) -> Column:
    """Nodes of whole blocks and at most two cut blocks that cover the ranks [lo, hi), as array of (node, lo, hi)."""
    spot = lambda level, k, a, b: F.struct((F.lit(level << NODE_BITS) + k).alias("node"), a.alias("lo"), b.alias("hi"))
    size = 1 << low
    first, end = F.shiftright(lo + F.lit(size - 1), low), F.shiftright(hi, low)
    nodes = F.transform(cover_nodes(first, end, levels - low), lambda c: spot_of(c, low))
    inside = first > end
    left = F.when(~inside & (lo % size != 0), spot(CUT, first - 1, lo, first * size))
    right = F.when(~inside & (hi % size != 0), spot(CUT, end, end * size, hi))
    return F.concat(nodes, F.array_compact(F.array(F.when(inside & (lo < hi), spot(CUT, end, lo, hi)), left, right)))


def spot_of(node: Column, low: int) -> Column:
    """A node of blocks as (node, lo, hi) of ranks."""
    zero = F.lit(0).cast("long")
    return F.struct(((node["l"].cast("long") + low) * (1 << NODE_BITS) + node["k"]).alias("node"), zero.alias("lo"), zero.alias("hi"))


def weights_inside(values: np.ndarray, weights: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per query the weight of the values in [lo, hi) among those at the places [start, end).

    Values are split by one bit after the other, the highest first, zeros before ones, so that the places of a query stay
    a stretch on every level (a wavelet matrix).
    """
    known, codes = np.unique(values, return_inverse=True)
    bits = len(known).bit_length()
    bounds = [np.searchsorted(known, c) for c in (lo, hi)]
    places = [(start, end), (start, end)]
    sums = [np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)]
    for bit in reversed(range(bits)):
        ones = codes >> bit & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        order = np.concatenate([np.flatnonzero(~ones), np.flatnonzero(ones)])
        codes, weights = codes[order], weights[order]
        upto = np.concatenate([[0], np.cumsum(weights)])
        for k, bound in enumerate(bounds):
            high = bound >> bit & 1 == 1
            a, b = (zeros[p] for p in places[k])
            sums[k] += np.where(high, upto[b] - upto[a], 0)
            places[k] = tuple(np.where(high, zeros[-1] + p - z, z) for p, z in zip(places[k], (a, b)))
    return sums[1] - sums[0]


def count_inside(node: np.ndarray, points: dict[str, np.ndarray], at: np.ndarray, boxes: dict[str, np.ndarray]) -> int:
    """Weighted pairs of points and boxes of equal node, the point's last two ranks inside the box."""
    found = 0
    known, code = np.unique(node, return_inverse=True)
    base = int(max(points["r1"].max(initial=0), boxes["hi1"].max(initial=0))) + 1
    order = np.argsort(code * base + points["r1"], kind="stable")
    placed = (code * base + points["r1"])[order]
    values, weights = points["r2"][order], points["w"][order]
    group = np.searchsorted(known, at)
    use = np.flatnonzero((group < len(known)) & (known[np.minimum(group, len(known) - 1)] == at)) if len(known) else np.zeros(0, int)
    for some in np.array_split(use, len(use) // BLOCK_POINTS + 1):
        start, end = (np.searchsorted(placed, group[some] * base + boxes[c][some]) for c in ("lo1", "hi1"))
        inside = weights_inside(values, weights, start, end, boxes["lo2"][some], boxes["hi2"][some])
        found += int((inside * boxes["w"][some]).sum())
    return found


def pairs_of_blocks(points: dict[str, np.ndarray], boxes: dict[str, np.ndarray], low: int) -> int:
    """Weighted pairs of the points and boxes of some nodes; ranks inside cut blocks are split into dyadic nodes here."""
    pick = lambda columns, mask: {c: v[mask] for c, v in columns.items()}
    cut, cut_box = (c["cut"] for c in (points, boxes))
    total = count_inside(points["node"][~cut], pick(points, ~cut), boxes["node"][~cut_box], pick(boxes, ~cut_box))
    points, boxes = pick(points, cut), pick(boxes, cut_box)
    if not len(points["node"]) or not len(boxes["node"]):
        return total
    width, inner = 1 << low, lambda columns, c: columns[c] & ((1 << low) - 1)
    lo, hi = inner(boxes, "lo"), boxes["hi"] - (boxes["lo"] & ~np.int64(width - 1))
    for l in range(low):
        first, end = (lo + (1 << l) - 1) >> l, hi >> l
        for use, k in (((first < end) & (first & 1 == 1), first), ((first < end) & (end & 1 == 1), end - 1)):
            if use.any():
                total += count_inside(points["node"] * width + (inner(points, "r") >> l), points, (boxes["node"] * width + k)[use], pick(boxes, use))
    return total


def box_seconds(rows: int, distinct_values: int, dim: int) -> float:
    """Estimated core seconds of :func:`box_pairs`."""
    levels = max(distinct_values - 1, 1).bit_length() + 1
    return rows * levels**2 * (2.3 * levels) ** max(dim - 3, 0) * BOX_LEVEL_SECONDS


def box_pairs(series: Series, vectors: DataFrame, dim: int, distinct_values: int) -> DataFrame:
    """(keys, pairs): ordered pairs of vectors inside each other's box.

    ``vectors`` holds per row ``n`` and an array ``v`` of ``dim`` structs (rank,
    lo, hi). Self pairs count. Equal vectors are merged into one weighted vector
    first. Light nodes are dealt many to a group; what meets in a heavy node is
    dealt into parts of bounded size on both sides.
    """
    keys = series.key_cols()
    levels = max(distinct_values - 1, 1).bit_length()
    low = max(0, levels - (max(series.longest // BLOCK_POINTS, 1) - 1).bit_length())
    merged = stored(vectors.groupBy(*keys, "n", "v").agg(F.count(F.lit(1)).alias("w")))
    middle = range(1, dim - 2)
    names = ["node", *[f"n{d}" for d in middle]]

    def nodes(rows: DataFrame, v: str, box: bool) -> DataFrame:
        spot = lambda d: F.col(v)[d]
        first = block_cover(spot(0)["lo"], spot(0)["hi"], low, levels) if box else block_nodes(spot(0)["rank"], low, levels)
        rows = rows.withColumn("__s", F.explode(first)).select("*", "__s.*").drop("__s")
        for d in middle:
            parts = cover_nodes(spot(d)["lo"], spot(d)["hi"], levels) if box else point_nodes(spot(d)["rank"], levels)
            rows = rows.withColumn(f"n{d}", F.explode(F.transform(parts, lambda c: c["l"].cast("long") * (1 << NODE_BITS) + c["k"])))
        return rows

    # Nodes with many rows are found by counting the different first ranks only.
    seen = merged.groupBy(*keys, F.slice("v", 1, max(dim - 2, 1)).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    seen = seen.repartition(series.tasks(), *keys, "h")
    sides = [nodes(seen, "h", box).select(*keys, *names, F.when(F.lit(box), F.col("c")).otherwise(0).alias("b"), F.when(F.lit(box), 0).otherwise(F.col("c")).alias("p")) for box in (False, True)]
    parts = [F.ceil(F.sum(c) / F.lit(PART)).cast("int").alias(f"__{c}") for c in ("p", "b")]
    heavy = sides[0].unionByName(sides[1]).groupBy(*keys, *names).agg(*parts).where("__p > 0 and __b > 0 and __p + __b > 2")
    heavy = stored(heavy.withColumn("__id", F.monotonically_increasing_id()))
    heavy = broadcast_if(heavy, heavy.count())

    def dealt(box: bool) -> DataFrame:
        rows = merged.repartition(series.tasks((levels - low + 2) * (2.3 * levels) ** len(middle)), *keys, "v")
        own, other = ("b", "p") if box else ("p", "b")
        rows = join_on(nodes(rows, "v", box), heavy, [*series.keys, *names], "left")
        turn = F.pmod(F.xxhash64("v"), F.coalesce(F.col(f"__{own}"), F.lit(1))).cast("int")
        rows = rows.withColumn(f"__{own}at", turn).withColumn(f"__{other}at", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"__{other}"), F.lit(1)) - 1)))
        groups = F.ceil(F.col("n") * F.lit((levels - low + 2) * (2.3 * levels) ** len(middle)) / F.lit(PART)).cast("long")
        light = F.pmod(F.xxhash64(*names), groups)
        deal = F.struct(F.coalesce("__id", F.lit(-1)).alias("id"), F.when(F.col("__id").isNull(), light).otherwise(F.lit(0)).alias("light"), "__pat", "__bat")
        both = lambda d, a, b: F.col("v")[d][a] * F.lit(1 << 32) + F.col("v")[d][b]
        last = [d for d in (dim - 2, dim - 1) if d > 0]
        spans = [both(d, "lo", "hi").alias(f"s{k}") for k, d in enumerate(last)] if box else [F.col("v")[d]["rank"].alias(f"s{k}") for k, d in enumerate(last)]
        extra = ["lo", "hi"] if box else ["r"]
        return rows.select(*keys, deal.alias("deal"), *names, *extra, *spans, "w")

    def read(table: pa.Table, box: bool) -> dict[str, np.ndarray]:
        column = lambda c: table[c].to_numpy().astype(np.int64)
        out = {c: column(c) for c in (("lo", "hi", "w") if box else ("r", "w"))}
        spans = [column(c) for c in table.column_names if c in ("s0", "s1")]
        # Of two dimensions the second is the only one left.
        for k, s in zip((1, 2), spans if len(spans) == 2 else [*spans, None]):
            if box:
                out[f"lo{k}"], out[f"hi{k}"] = (s >> 32, s & 0xFFFFFFFF) if s is not None else (np.zeros_like(out["w"]), np.ones_like(out["w"]))
            else:
                out[f"r{k}"] = s if s is not None else np.zeros_like(out["w"])
        out["cut"] = column("node") >> NODE_BITS == CUT
        return out

    own_keys = list(series.keys)
    fields = [merged.schema[c] for c in own_keys]

    def counted(points: pa.Table, boxes: pa.Table) -> pa.Table:
        one = points if points.num_rows else boxes
        total = 0
        if points.num_rows and boxes.num_rows:
            sides = [read(points, False), read(boxes, True)]
            code, at = np.zeros(points.num_rows, np.int64), np.zeros(boxes.num_rows, np.int64)
            for c in names:
                known, number = np.unique(np.concatenate([points[c].to_numpy(), boxes[c].to_numpy()]), return_inverse=True)
                _, number = np.unique(np.concatenate([code, at]) * len(known) + number, return_inverse=True)
                code, at = number[: len(code)], number[len(code) :]
            sides[0]["node"], sides[1]["node"] = code, at
            total = pairs_of_blocks(*sides, low)
        return pa.table({**{c: one[c].slice(0, 1) for c in own_keys}, "pairs": pa.array([total], pa.int64())})

    by = [*keys, F.col("deal")]
    schema = StructType([*fields, StructField("pairs", LongType())])
    points, boxes = dealt(False), dealt(True)
    # Both sides come from one table: the boxes' columns get names of their own.
    boxes = boxes.select(*[ref(c).alias(c) for c in boxes.columns])
    found = points.groupBy(*by).cogroup(boxes.groupBy(*by)).applyInArrow(counted, schema)
    return found.groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
