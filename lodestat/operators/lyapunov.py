"""Largest Lyapunov exponent from the divergence of nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lodestat.columns import ref
from lodestat.errors import InsufficientData
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.nearest import nearest_neighbours
from lodestat.plans.series import Series
from lodestat.plans.tiles import BROADCAST_VALUES, TILE, chunk_arrays

#: Chunks of a long series, rows of one at most, steps followed at once, and distances in one product at most.
SPANS, MOST_ROWS, STRETCH, FACTORS = 16, 1 << 20, 1 << 14, 16
#: Products stay below the first and, but for distances that are looked at one by one, far above the second.
LARGEST, SMALLEST = 1e100, 1e-300
#: Steps of all tracks that a task follows, and tasks of a core where chunks are sent to tasks.
STEPS_PER_TASK, TASKS_PER_CORE = 1_000_000_000, 16
SUMS = StructType([StructField("total", ArrayType(DoubleType())), StructField("count", ArrayType(LongType()))])


def track_size(series: Series) -> int:
    """Rows of a chunk: a fixed number of them for long series, so that the arrays sent grow with the rows and no faster."""
    return max(TILE, min(-(-series.longest // SPANS), MOST_ROWS))


def met_tracks(series: Series, pairs: DataFrame, dim: int, tau: int) -> DataFrame:
    """(keys, a, b, block, n, steps, spots): the tracks that start in two chunks, a block of steps at a time.

    A distance has no direction, so a track runs from the earlier row of its pair to the later one.
    """
    keys, size = series.key_cols(), track_size(series)
    vectors = F.col("n") - (dim - 1) * tau
    quarter = F.floor(vectors / 4)
    steps = F.least(F.greatest(F.floor(quarter / 10), F.lit(5)), quarter)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((steps - 1) / size).cast("long")))
    tracks = pairs.select(*keys, "n", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), steps.alias("steps")).where(F.col("steps") > 0).withColumn("block", blocks)
    shift = F.col("block") * size
    tracks = tracks.select(*keys, "n", "steps", "block", (F.col("i") + shift).alias("u"), (F.col("j") + shift).alias("v"))
    tracks = tracks.where((F.col("u") < vectors) & (F.col("v") < vectors))
    home = lambda c: F.floor(F.col(c) / size).cast("long")
    spots = F.collect_list(F.struct((F.col("u") % size).cast("int").alias("u"), (F.col("v") % size).cast("int").alias("v")))
    return tracks.withColumn("a", home("u")).withColumn("b", home("v")).groupBy(*keys, "a", "b", "block", "n", "steps").agg(spots.alias("spots"))


def log_sums(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, ends: np.ndarray, weight: np.ndarray, dim: int, tau: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per step the summed log distance and the number of the tracks that are apart there.

    A track starts at ``u`` in x and ``v`` in y, counts ``weight`` times and has ``ends`` steps, ``count`` at most. Squared
    distances are multiplied over :data:`FACTORS` tracks of one weight before their log is taken. Where a product is too
    small for all its factors to be positive and every partial product exact, the distances are looked at one by one.
    """
    reach = (dim - 1) * tau
    total = np.zeros(count)
    seen = np.cumsum(np.bincount(np.minimum(ends, count), weight, count + 1)[::-1])[::-1][1:].astype("int64")
    values = np.concatenate([x, y])
    with np.errstate(all="ignore"):
        largest = max(1.0, float(dim * np.square(np.fmax.reduce(values) - np.fmin.reduce(values))))
    few = max(1, min(FACTORS, int(np.log(LARGEST) / max(np.log(largest), 1e-9)))) if np.isfinite(largest) else 1
    floor = SMALLEST * largest**few if few > 1 else 0.0
    span = min(count, STRETCH)
    apart, single, product = np.empty(span + reach), np.empty(span), np.empty(span)

    def gaps(track: int, start: int, width: int, out: np.ndarray) -> np.ndarray:
        """Squared distances of a track over a stretch of steps; 1 behind its end."""
        a, b = u[track] + start, v[track] + start
        step = np.subtract(x[a : a + width + reach], y[b : b + width + reach], out=apart[: width + reach])
        np.multiply(step, step, out=step)
        gap = out[:width]
        if dim == 1:
            gap[:] = step
        else:
            np.add(step[:width], step[tau : tau + width], out=gap)
        for k in range(2, dim):
            np.add(gap, step[k * tau : k * tau + width], out=gap)
        gap[max(ends[track] - start, 0) :] = 1.0
        return gap

    order = np.lexsort((u, weight))
    edges = np.flatnonzero(np.diff(weight[order])) + 1
    with np.errstate(all="ignore"):
        for start in range(0, count, span):
            width = min(span, count - start)
            for same in np.split(order, edges):
                same = same[ends[same] > start]
                times = weight[same[0]] if len(same) else 0
                for first in range(0, len(same), few):
                    group = same[first : first + few].tolist()
                    whole = gaps(group[0], start, width, product)
                    for track in group[1:]:
                        np.multiply(whole, gaps(track, start, width, single), out=whole)
                    small = np.flatnonzero(~(whole > floor))
                    if len(small):
                        whole[small] = 1.0
                        for track in group:
                            gap = gaps(track, start, width, single)[small]
                            use = gap > 0
                            total[start + small[use]] += times * 0.5 * np.log(gap[use])
                            seen[start + small[~use]] -= times
                    total[start : start + width] += times * 0.5 * np.log(whole)
    return total, seen


def tracks_met(series: Series, met: DataFrame, chunks: DataFrame, bins: int, follow: Callable) -> DataFrame:
    """(keys, block, total, count): the sums of the tracks of every bin, to which both chunks of a pair are sent once.

    Chunk pairs of a series are dealt over its bins one after the other, so bins are even and add up most of the sums.
    """
    keys, own_keys, size = series.key_cols(), list(series.keys), track_size(series)
    share = max(1, math.ceil(bins * float(series.longest) ** 2 / max(series.squares, 1.0)))
    bin_of = F.pmod(F.xxhash64(*keys) + F.pmod((F.col("b") * (F.col("b") + 1)) / 2 + F.col("a"), F.lit(share)).cast("long"), F.lit(bins)).cast("int")
    last = F.floor((F.col("n") - 1) / size).cast("long")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    others = F.sequence(F.lit(0).cast("long"), last)
    home = F.col("chunk")
    sent = chunks.select(*keys, "chunk", "xs", F.explode(F.transform(others, lambda c: pair(F.least(home, c), F.greatest(home, c)))).alias("__p"))
    sent = sent.select(*keys, "__p.a", "__p.b", "chunk", "xs").withColumn("bin", bin_of).repartitionById(bins, F.col("bin"))
    tracks = met.withColumn("u", F.col("spots.u")).withColumn("v", F.col("spots.v")).drop("spots").withColumn("bin", bin_of).repartitionById(bins, F.col("bin"))
    # Both sides have the keys of one table: the arrays' columns get names of their own.
    sent = sent.select(*[ref(c).alias(c) for c in sent.columns])

    def names(table: pa.Table, *also: str) -> list[tuple]:
        """Rows of the key columns, NaN equal to itself."""
        columns = [[repr(k) for k in table[c].to_pylist()] for c in own_keys]
        return list(zip(*columns, *[table[c].to_pylist() for c in also]))

    def added(tracks: pa.Table, arrays: pa.Table) -> pa.Table:
        places = {name: row for row, name in enumerate(names(arrays, "a", "b", "chunk"))}
        read = lambda table, c, row: table[c][row].values.to_numpy(zero_copy_only=False)
        sums: dict[tuple, tuple] = {}
        for row, name in enumerate(names(tracks, "block")):
            a, b, top, span = (tracks[c][row].as_py() for c in ("a", "b", "top", "span"))
            x, y = (read(arrays, "xs", places[(*name[:-1], a, b, c)]) for c in (a, b))
            total, seen = follow(x, y, read(tracks, "u", row), read(tracks, "v", row), a, b, top, span)
            if name in sums:
                sums[name][1][:] += total
                sums[name][2][:] += seen
            else:
                sums[name] = (row, total, seen)
        lists = lambda k, kind: pa.array([found[k] for found in sums.values()], pa.list_(kind))
        one = pa.array([row for row, _, _ in sums.values()], pa.int64())
        return pa.table({**{c: tracks[c].take(one) for c in [*own_keys, "block"]}, "total": lists(1, pa.float64()), "count": lists(2, pa.int64())})

    schema = StructType([*[met.schema[c] for c in [*own_keys, "block"]], *SUMS.fields])
    return tracks.groupBy("bin").cogroup(sent.groupBy("bin")).applyInArrow(added, schema)


def divergence(series: Series, pairs: DataFrame, dim: int, tau: int) -> DataFrame:
    """(keys, step, mean_log): mean log distance of the pairs after each step.

    Only the steps that enter the fit are followed. Pairs meet the two chunks
    their tracks run through, a block of steps at a time, so each task row
    holds two bounded arrays and returns per-step sums.
    """
    keys, size = series.key_cols(), track_size(series)
    reach = (dim - 1) * tau
    vectors = F.col("n") - reach
    # Each pair is followed for up to a fortieth of the series. The chunk pairs of a series are dealt over a share of the
    # tasks, as large as its share of the steps; a task adds them up before the shuffle and sends its sums only.
    longest = max(series.longest // 40, 5)
    tasks = series.tasks(longest, STEPS_PER_TASK)
    span = F.least(F.lit(size), F.col("steps") - F.col("block") * size).cast("long")
    met = met_tracks(series, pairs, dim, tau).select(*keys, "a", "b", "block", vectors.alias("top"), span.alias("span"), "spots")
    chunks = chunk_arrays(series, min(size, longest) + reach, size)

    def follow(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, a: int, b: int, top: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        width = size + count + reach
        x, y = (np.pad(z[:width], (0, max(width - len(z), 0)), constant_values=np.nan) for z in (x, y))
        # Where two rows are each other's neighbours their track is followed once and counts twice.
        track, weight = np.unique(np.asarray(u, np.int64) * size + np.asarray(v), return_counts=True)
        u, v = np.divmod(track, size)
        return log_sums(x, y, u, v, np.minimum(top - a * size - u, top - b * size - v), weight, dim, tau, count)

    @F.pandas_udf(SUMS)
    def follow_rows(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([follow(*row) for row in zip(*columns)], columns=SUMS.names)

    if series.rows <= BROADCAST_VALUES:
        share = max(1, min(tasks, math.ceil(tasks * float(series.longest) ** 2 / max(series.squares, 1.0))))
        task = F.xxhash64(*keys) + F.col("block") * share + F.pmod(F.xxhash64("a", "b"), F.lit(share))
        met = met.repartitionById(tasks, F.pmod(task, F.lit(tasks)).cast("int"))
        left = chunks.select(*keys, F.col("chunk").alias("a"), F.col("xs").alias("left"))
        right = chunks.select(*keys, F.col("chunk").alias("b"), F.col("xs").alias("right"))
        tiles = join_on(join_on(met, F.broadcast(left), [*series.keys, "a"]), F.broadcast(right), [*series.keys, "b"])
        sums = follow_rows("left", "right", F.col("spots.u"), F.col("spots.v"), "a", "b", "top", "span")
        followed = tiles.select(*keys, "block", sums.alias("__f")).select(*keys, "block", "__f.total", "__f.count")
    else:
        # Few tasks of many steps send few sums; there are no more than chunk pairs, and each receives a bounded number of rows.
        cores = series.df.sparkSession.sparkContext.defaultParallelism
        wanted = max(min(tasks, TASKS_PER_CORE * cores), series.tasks(longest, 25 * STEPS_PER_TASK), series.rows // MOST_ROWS + 1)
        followed = tracks_met(series, met, chunks, wanted, follow)
    lines = followed.select(*keys, "block", F.posexplode(F.arrays_zip("total", "count")).alias("__p", "__z"))
    step = F.col("block") * size + F.col("__p")
    sums = lines.groupBy(*keys, step.alias("step")).agg(F.sum("__z.total").alias("total"), F.sum("__z.count").alias("count"))
    return sums.where(F.col("count") > 0).select(*keys, "step", (F.col("total") / F.col("count")).alias("mean_log"))


def lyapunov_exponent(series: Series, embedding_dim: int, tau: int, method: str = "auto") -> DataFrame:
    """Slope of the mean log divergence over the first tenth of the steps.

    The neighbour of a vector is the nearest other vector at a positive
    distance and at least (dim-1) tau + 1 steps away, the earliest among
    equals. A series with fewer than two usable steps yields NULL.
    """
    if embedding_dim < 1 or tau < 1:
        raise InsufficientData(1)
    reach = (embedding_dim - 1) * tau
    series.require(20 + reach)
    pairs = stored(nearest_neighbours(series, embedding_dim, tau, method))
    curve = divergence(series, pairs, embedding_dim, tau)
    slope = F.when(F.count(F.lit(1)) >= 2, F.coalesce(F.regr_slope("mean_log", "step"), F.lit(0.0)))
    fitted = curve.groupBy(*series.key_cols()).agg(slope.alias("lyapunov_exponent"))
    every = series.df.where(F.col("t") == 0).select(*series.key_cols())
    return series.present(join_on(every, fitted, series.keys, "left"), "lyapunov_exponent")
