"""Nearest neighbours of delay vectors with a temporal exclusion window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.series import Series, embedded
from lodestat.plans.spacetree import nearest_points
from lodestat.plans.tiles import BROADCAST_VALUES, PAIRS_PER_TASK, TILE, chunk_arrays

BEST = StructType([StructField("d", ArrayType(DoubleType())), StructField("j", ArrayType(LongType()))])


def delay_vectors(xs: np.ndarray, dim: int, tau: int, limit: int) -> np.ndarray:
    """dim x count matrix of the delay vectors that start in this chunk."""
    count = max(min(TILE, limit, len(xs) - (dim - 1) * tau), 0)
    return np.stack([np.asarray(xs[k * tau : k * tau + count], dtype=float) for k in range(dim)])


def best_in_tile(left: np.ndarray, right: np.ndarray, gap: int, apart: int, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Per left vector the smallest positive distance and its first right index.

    ``gap`` is the start of the right chunk minus that of the left; pairs less
    than ``apart`` steps from each other are left out.
    """
    rows, cols = left.shape[1], right.shape[1]
    distance, index = np.full(rows, np.inf), np.zeros(rows, dtype="int64")
    close = abs(gap) < TILE + apart
    for start in range(0, rows, step):
        block = left[:, start : start + step]
        squares = np.zeros((block.shape[1], cols))
        for k in range(len(left)):
            d = block[k][:, None] - right[k][None, :]
            squares += np.multiply(d, d, out=d)
        squares[squares == 0] = np.inf
        if close:
            lag = gap + np.arange(cols)[None, :] - (start + np.arange(block.shape[1]))[:, None]
            squares[np.abs(lag) < apart] = np.inf
        # Roots are compared: different squares can have equal roots.
        roots = np.sqrt(squares, out=squares)
        at = roots.argmin(axis=1)
        distance[start : start + step] = roots[np.arange(len(at)), at]
        index[start : start + step] = at
    return distance, index


def neighbours_by_tiles(series: Series, dim: int, tau: int) -> DataFrame:
    """(keys, n, i, j, d) comparing every pair of chunks."""
    keys = series.key_cols()
    reach = (dim - 1) * tau
    apart = reach + 1
    chunks = chunk_arrays(series, reach)
    last = F.floor((F.col("n") - 1) / TILE).cast("long")
    pairs = chunks.select(*keys, F.col("chunk").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("b"))
    hint = F.broadcast if series.rows <= BROADCAST_VALUES else (lambda d: d)
    left = chunks.select(*keys, "n", F.col("chunk").alias("a"), F.col("xs").alias("left"))
    right = chunks.select(*keys, F.col("chunk").alias("b"), F.col("xs").alias("right"))
    tile_count = series.count + series.rows * (series.longest // TILE + 1) // TILE
    spread = pairs.repartition(max(series.tasks(), tile_count // PAIRS_PER_TASK + 1), *keys, "a", F.col("b") % 8)
    tiles = join_on(join_on(spread, hint(left), [*series.keys, "a"]), hint(right), [*series.keys, "b"])

    @F.pandas_udf(BEST)
    def best(xs: pd.Series, ys: pd.Series, a: pd.Series, b: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        distances, indices = [], []
        for x, y, ca, cb, top in zip(xs, ys, a, b, vectors):
            left_v = delay_vectors(x, dim, tau, top - ca * TILE)
            right_v = delay_vectors(y, dim, tau, top - cb * TILE)
            if right_v.shape[1] == 0 or left_v.shape[1] == 0:
                distances.append(np.zeros(0))
                indices.append(np.zeros(0, dtype="int64"))
                continue
            d, j = best_in_tile(left_v, right_v, (cb - ca) * TILE, apart)
            distances.append(d)
            indices.append(j + cb * TILE)
        return pd.DataFrame({"d": distances, "j": indices})

    found = tiles.select(*keys, "n", "a", best("left", "right", "a", "b", F.col("n") - reach).alias("__b"))
    lines = found.select(*keys, "n", "a", F.posexplode(F.arrays_zip("__b.d", "__b.j")).alias("__p", "__z"))
    lines = lines.where(F.col("__z.d") < F.lit(float("inf")))
    nearest = lines.groupBy(*keys, "n", (F.col("a") * TILE + F.col("__p")).alias("i")).agg(F.min("__z").alias("__z"))
    return nearest.select(*keys, "n", "i", F.col("__z.j").alias("j"), F.col("__z.d").alias("d"))


# Core seconds per ordered pair of vectors, per searched vector of up to 3 values (both measured; it triples with each
# further value, an estimate, up to the last) and of the stages of a search.
TILE_PAIR_SECONDS = 1.1e-8
TREE_ROW_SECONDS, TREE_SECONDS, MOST_ROW_SECONDS = 2e-4, 40, 4e-3


def tree_seconds(rows: int, dim: int) -> float:
    """Estimated core seconds of a search by a space partition."""
    return TREE_SECONDS + rows * min(TREE_ROW_SECONDS * 3.0 ** max(dim - 3, 0), MOST_ROW_SECONDS)


def neighbours_by_tree(series: Series, dim: int, tau: int) -> DataFrame:
    """(keys, n, i, j, d) by searching the leaves of a balanced space partition.

    Equal vectors are one point with its earliest times: an exclusion window
    removes fewer than ``keep`` = 2 apart times, so the ``keep`` smallest
    (distance, time) pairs of a vector answer every row that has it.
    """
    keys = series.key_cols()
    apart = (dim - 1) * tau + 1
    keep = 2 * apart
    vectors = stored(embedded(series, dim, tau))
    earliest = F.row_number().over(Window.partitionBy(*keys, "v").orderBy("i"))
    times = vectors.withColumn("__r", earliest).where(F.col("__r") <= keep).groupBy(*keys, "v").agg(F.sort_array(F.collect_list("i")).alias("times"))
    # A vector's first time names it within its series.
    points = stored(times.select(*keys, F.col("times")[0].alias("id"), "v", "times"))
    near = nearest_points(points, series.keys, dim, keep)
    answers = join_on(points.select(*keys, "id", "v"), near, [*series.keys, "id"]).drop("id")

    rows = join_on(vectors, answers, [*series.keys, "v"])
    allowed = F.filter("near", lambda c: F.abs(c["j"] - F.col("i")) >= apart)
    chosen = rows.withColumn("__z", F.get(allowed, F.lit(0))).where(F.col("__z").isNotNull())
    return chosen.select(*keys, "n", "i", F.col("__z.j").alias("j"), F.col("__z.d").alias("d"))


def nearest_neighbours(series: Series, dim: int, tau: int, method: str = "auto") -> DataFrame:
    """(keys, n, i, j, d): the nearest allowed neighbour of every delay vector.

    ``method`` is "tiles" (all chunk pairs), "tree" (by leaves of a space
    partition) or "auto", which compares their estimated core seconds.
    """
    if method == "auto":
        method = "tiles" if series.squares * TILE_PAIR_SECONDS <= tree_seconds(series.rows, dim) else "tree"
    return neighbours_by_tiles(series, dim, tau) if method == "tiles" else neighbours_by_tree(series, dim, tau)
