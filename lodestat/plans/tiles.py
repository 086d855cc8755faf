"""Pair statistics by blocks of a series, for series of moderate length.

A series is cut into chunks of :data:`TILE` consecutive rows; every pair of
chunks is one small task row that carries two bounded arrays and returns one
number. Pairs of points never become rows, and a series that holds most of the
table is just more chunk pairs. The arithmetic is quadratic in the length, so
callers compare :func:`tile_seconds` with the cost of a subquadratic plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestat.columns import ref
from lodestat.plans.boxcount import far_end
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import broadcast_if, join_on
from lodestat.plans.series import Series

TILE = 2_048
# Chunk arrays are broadcast up to this many values (8 bytes each) in total.
BROADCAST_VALUES = 4_000_000
# Chunk pairs of TILE rows that one task receives at most; bounds its Arrow batch.
PAIRS_PER_TASK = 128
# Chunks of a long series, and tiles of the longest chunk.
SPANS, MOST_TILES = 16, 256
# Tasks of a core, and core seconds of one at most, where chunks are sent to tasks.
TASKS_PER_CORE, TASK_SECONDS = 16, 30
# Core seconds per pair of vectors of three values (measured, half of the blocks left out or covered in a place).
TILE_PAIR_SECONDS = 5e-11


def chunk_arrays(series: Series, overlap: int, size: int = TILE) -> DataFrame:
    """(keys, chunk, n, xs): values of a chunk and the ``overlap`` rows after it."""
    chunk = F.floor(F.col("t") / size).cast("long")
    reach = -(-overlap // size)
    homes = [chunk]
    for back in range(1, reach + 1):
        inside = F.col("t") % size + (back - 1) * size < overlap
        homes.append(F.when(inside & (chunk >= back), chunk - back))
    placed = series.df.withColumn("chunk", F.explode(F.array_compact(F.array(*homes))))
    cells = F.sort_array(F.collect_list(F.struct("t", "x")))
    grouped = placed.groupBy(*series.key_cols(), "chunk").agg(F.max("n").alias("n"), cells.alias("__c"))
    return grouped.select(*series.key_cols(), "chunk", "n", F.transform("__c", lambda c: c["x"]).alias("xs"))


def bits_below(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitsets of the 0, 1, 2, .. smallest of some places, and how many of them lie below each of 0 .. ``size``."""
    order = np.argsort(places, kind="stable")
    sets = np.zeros((len(places) + 1, -(-len(places) // 64)), dtype=np.uint64)
    sets[np.arange(1, len(places) + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
    below = np.zeros(size + 1, dtype=np.int32)
    np.cumsum(np.bincount(places, minlength=size), out=below[1:])
    return np.bitwise_or.accumulate(sets, axis=0, out=sets), below


def near_tile(low: np.ndarray, high: np.ndarray, right: np.ndarray, dim: int, same: bool) -> int:
    """Pairs (i < j, where both sides are the ``same``) of two stretches whose ``dim`` successive values are near.

    Near a value are those strictly between its ``low`` and ``high``, a stretch of the other side's sorted values. Both
    sides' vectors are ordered by their first value and compared :data:`TILE` by as many: blocks that lie apart in any
    place of the vectors are left out, and so is a place in which all are near. In the others the values near a value
    are the difference of two bitsets, and vectors are near where the bitsets of all their values have a common bit.
    """
    rows, cols = len(low) - dim + 1, len(right) - dim + 1
    if rows < 1 or cols < 1:
        return 0
    known = np.sort(right)
    place = np.searchsorted(known, right, "left")
    first = np.searchsorted(known, low, "right")
    last = np.maximum(np.searchsorted(known, high, "left"), first)
    theirs = np.argsort(place[:cols], kind="stable")
    own = theirs if same else np.argsort(first[:rows], kind="stable")
    first, last = (np.stack([ends[own + k] for k in range(dim)]) for ends in (first, last))
    starts = np.arange(0, rows, TILE)
    from_least, from_most, to_least, to_most = (f.reduceat(ends, starts, axis=1) for ends in (first, last) for f in (np.minimum, np.maximum))
    count = twice = 0
    for j, start in enumerate(range(0, cols, TILE)):
        places = np.stack([place[theirs[start : start + TILE] + k] for k in range(dim)])
        bottom, top = places.min(axis=1)[:, None], places.max(axis=1)[:, None]
        reached = ((from_least <= top) & (to_most > bottom)).all(axis=0)
        covered = (from_most <= bottom) & (to_least > top)
        if same:
            reached[:j] = False
        blocks = np.flatnonzero(reached)
        if not len(blocks):
            continue
        bits = [None if covered[k, blocks].all() else bits_below(places[k], len(known)) for k in range(dim)]
        width = places.shape[1]
        near, other, both = (np.empty((min(rows, TILE), -(-width // 64)), np.uint64) for _ in range(3))
        for i in blocks.tolist():
            some = slice(i * TILE, min((i + 1) * TILE, rows))
            size, open_places = some.stop - some.start, [k for k in range(dim) if not covered[k, i]]
            found = size * width
            for k in open_places:
                sets, below = bits[k]
                into = (both if k == open_places[0] else near)[:size]
                np.take(sets, below[last[k, some]], axis=0, out=into, mode="clip")
                np.take(sets, below[first[k, some]], axis=0, out=other[:size], mode="clip")
                np.bitwise_xor(into, other[:size], out=into)
                if into.base is near:
                    np.bitwise_and(both[:size], into, out=both[:size])
            if open_places:
                found = int(np.bitwise_count(both[:size]).sum())
            if same and i == j:
                twice += found
            else:
                count += found
    if not same:
        return count
    mine = np.stack([place[own + k] for k in range(dim)])
    return count + (twice - int(((first <= mine) & (mine < last)).all(axis=0).sum())) // 2


def tile_size(series: Series) -> int:
    """Rows of a chunk: longer ones for longer series, so that arrays are sent to few pairs of chunks."""
    return TILE * max(1, min(MOST_TILES, series.longest // (SPANS * TILE)))


def near_pairs(series: Series, dim: int, eps: float) -> DataFrame:
    """(keys, near): unordered pairs of embedded vectors closer than eps.

    Pairs of different chunks whose ranges of values lie eps apart are dropped
    before they receive their arrays.
    """
    keys, size = series.key_cols(), tile_size(series)
    chunks = chunk_arrays(series, dim - 1, size)

    @F.pandas_udf("low array<double>, high array<double>")
    def ends(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"low": [far_end(x, eps, -1) for x in xs], "high": [far_end(x, eps, 1) for x in xs]})

    chunks = chunks.withColumn("__ends", ends("xs")).select(*keys, "chunk", "n", "xs", "__ends.low", "__ends.high")
    if series.rows > BROADCAST_VALUES:
        chunks = stored(chunks)
    bounds = F.struct(F.array_min("xs").alias("smallest"), F.array_max("xs").alias("largest"))
    last = F.floor((F.col("n") - 1) / size).cast("long")
    reach = [F.array_min("low").alias("bottom"), F.array_max("high").alias("top")]
    pairs = chunks.select(*keys, F.col("chunk").alias("a"), *reach, F.explode(F.sequence(F.col("chunk"), last)).alias("b"))
    ranges = chunks.select(*keys, F.col("chunk").alias("b"), bounds.alias("__range"))
    ranges = broadcast_if(ranges, series.count + series.rows // size)
    apart = (F.col("__range.smallest") >= F.col("top")) | (F.col("__range.largest") <= F.col("bottom"))
    pairs = join_on(pairs, ranges, [*series.keys, "b"]).where((F.col("a") == F.col("b")) | ~apart).select(*keys, "a", "b")

    counted = near_dealt(series, chunks, pairs, dim) if series.rows > BROADCAST_VALUES // 2 else near_spread(series, chunks, pairs, dim)
    return counted.groupBy(*keys).agg(F.sum("c").alias("near"))


def near_spread(series: Series, chunks: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """(keys, c): the near pairs of every pair of chunks, whose arrays are broadcast."""
    keys, size = series.key_cols(), tile_size(series)
    left = chunks.select(*keys, F.col("chunk").alias("a"), "low", "high")
    right = chunks.select(*keys, F.col("chunk").alias("b"), F.col("xs").alias("right"))
    tile_count = series.count + series.rows * (series.longest // size + 2) // (2 * size)
    spread = pairs.repartition(max(series.tasks(), tile_count * size // (TILE * PAIRS_PER_TASK) + 1), *keys, "a", "b")
    tiles = join_on(join_on(spread, F.broadcast(left), [*series.keys, "a"]), F.broadcast(right), [*series.keys, "b"])

    @F.pandas_udf(LongType())
    def count(low: pd.Series, high: pd.Series, right: pd.Series, same: pd.Series) -> pd.Series:
        return pd.Series([near_tile(x, y, z, dim, s) for x, y, z, s in zip(low, high, right, same)], dtype="int64")

    return tiles.select(*keys, count("low", "high", "right", F.col("a") == F.col("b")).alias("c"))


def near_dealt(series: Series, chunks: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """(keys, c): the near pairs of every pair of chunks, to whose task both arrays are sent once.

    Pairs of a series are dealt over its tasks one after the other, so that tasks are even.
    """
    keys, own_keys = series.key_cols(), list(series.keys)
    cores = series.df.sparkSession.sparkContext.defaultParallelism
    bins = max(TASKS_PER_CORE * cores, int(tile_seconds(series.squares) / TASK_SECONDS), series.rows // (TILE * MOST_TILES) + 1)
    share = max(1, min(bins, int(bins * float(series.longest) ** 2 / max(series.squares, 1.0)) + 1))
    turn = F.pmod((F.col("b") * (F.col("b") + 1)) / 2 + F.col("a"), F.lit(share)).cast("long")
    pairs = stored(pairs.withColumn("bin", F.pmod(F.xxhash64(*keys) + turn, F.lit(bins)).cast("int")))

    def sent(at: str, *columns: str) -> DataFrame:
        side = join_on(pairs, chunks.select(*keys, F.col("chunk").alias(at), *columns), [*series.keys, at])
        side = side.select(*[ref(c).alias(c) for c in [*own_keys, "a", "b", "bin", *columns]])
        return side.repartitionById(bins, F.col("bin"))

    def names(table: pa.Table) -> list[tuple]:
        # NaN is not equal to itself, its name is.
        return list(zip(*[[repr(k) for k in table[c].to_pylist()] for c in own_keys], table["a"].to_pylist(), table["b"].to_pylist()))

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        places = {name: row for row, name in enumerate(names(right))}
        read = lambda table, c, row: table[c][row].values.to_numpy(zero_copy_only=False)
        found = [
            near_tile(read(left, "low", row), read(left, "high", row), read(right, "xs", places[name]), dim, name[-2] == name[-1])
            for row, name in enumerate(names(left))
        ]
        return pa.table({**{c: left[c] for c in own_keys}, "c": pa.array(found, pa.int64())})

    schema = StructType([*[chunks.schema[c] for c in own_keys], StructField("c", LongType())])
    return sent("a", "low", "high").groupBy("bin").cogroup(sent("b", "xs").groupBy("bin")).applyInArrow(counted, schema)


def tile_seconds(squares: float) -> float:
    """Estimated core seconds of comparing all pairs by bitsets of tiles."""
    return squares / 2 * TILE_PAIR_SECONDS
