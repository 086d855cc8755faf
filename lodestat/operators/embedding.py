"""Delay and dimension of a state-space reconstruction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lodestat.columns import ref
from lodestat.errors import InsufficientData
from lodestat.operators.dependence import delay_information
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.series import Series, measured
from lodestat.plans.tiles import BROADCAST_VALUES, TILE, chunk_arrays

# Fixed values of the false-neighbour method.
GAP_RATIO = 15.0
QUERY_POINTS = 200
FALSE_SHARE = 0.01
LONGEST_DELAY = 50

#: Lags tried at once end here.
LAG_BLOCKS = (8, 24, LONGEST_DELAY)

FOUND = StructType(
    [StructField("d", ArrayType(DoubleType())), StructField("j", ArrayType(LongType())), StructField("ahead", ArrayType(DoubleType()))]
)


def optimal_delay(series: Series) -> DataFrame:
    """(keys, n, tau): first interior minimum of the lagged information, else 1.

    Lags are tried a block at a time, each block only for the series that have
    no minimum yet.
    """
    keys = series.key_cols()
    lengths = stored(series.df.where(F.col("t") == 0).select(*keys, "n"))
    last_lag = F.least(F.floor(F.col("n") / 4), F.lit(LONGEST_DELAY))
    left, before, found, first = series, None, [], 1
    while left.count and first <= min(left.longest // 4, LONGEST_DELAY):
        last = min(next(b for b in LAG_BLOCKS if b >= first), left.longest // 4)
        info = series.attach(delay_information(left, last, first), lengths).where(F.col("lag") <= last_lag)
        info = info.select(*keys, "lag", "mutual_information")
        # The last two lags of a block are the neighbours of the next one's first.
        info = stored(info if before is None else info.unionByName(left.attach(before, left.df.where(F.col("t") == 0).select(*keys))))
        order = Window.partitionBy(*keys).orderBy("lag")
        mi = F.col("mutual_information")
        low = (mi < F.lag(mi).over(order)) & (mi <= F.lead(mi).over(order))
        minima = info.select(*keys, F.when(low, F.col("lag")).alias("lag")).groupBy(*keys).agg(F.min("lag").alias("tau"))
        found.append(stored(minima.where(F.col("tau").isNotNull())))
        before, first = info.where(F.col("lag") >= last - 1), last + 1
        more = join_on(lengths.where(last_lag > last), found[-1], series.keys, "left").where(F.col("tau").isNull()).select(*keys)
        left = measured(series.attach(left.df, more), series.keys, series.names)
    chosen = reduce(DataFrame.unionByName, found) if found else lengths.select(*keys, F.lit(1).alias("tau")).limit(0)
    return join_on(lengths, chosen, series.keys, "left").select(*keys, "n", F.coalesce(F.col("tau"), F.lit(1)).cast("long").alias("tau"))


def query_points(series: Series, plan: DataFrame, max_dim: int) -> DataFrame:
    """(keys, dim, tau, n_check, q): up to 399 evenly spaced delay vectors per
    series and dimension, with the one value beyond each vector."""
    keys = series.key_cols()
    dims = plan.select(*keys, "n", "tau", F.explode(F.sequence(F.lit(1), F.lit(max_dim))).alias("dim"))
    dims = dims.withColumn("n_check", F.col("n") - F.col("dim") * F.col("tau")).where(F.col("n_check") >= 10)
    step = F.greatest(F.floor(F.col("n_check") / F.least(F.col("n_check"), F.lit(QUERY_POINTS))), F.lit(1))
    spots = dims.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_check") - 1, step.cast("long"))))
    parts = spots.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("dim"))))
    parts = parts.withColumn("t", F.col("i") + F.col("k") * F.col("tau")).drop("n")
    valued = join_on(parts, series.df.select(*keys, "t", "x"), [*series.keys, "t"])
    group = [*keys, "dim", "tau", "n_check"]
    vectors = valued.groupBy(*group, "i").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("__v"))
    flat = vectors.select(*group, F.struct("i", F.transform("__v", lambda c: c["x"]).alias("v")).alias("q"))
    return flat.groupBy(*group).agg(F.sort_array(F.collect_list("q")).alias("q"))


def false_neighbour_shares(series: Series, plan: DataFrame, max_dim: int) -> DataFrame:
    """(keys, dim, tau, n_check, share) for every dimension in one pass.

    Each chunk of a series meets the bounded query set of its series and
    returns one candidate per query; the minimum over chunks is the neighbour.
    """
    keys = series.key_cols()
    queries = stored(query_points(series, plan, max_dim))
    widest = plan.agg(F.max("tau")).first()[0] or 1
    chunks = chunk_arrays(series, max_dim * widest)
    group = [*series.keys, "dim", "tau", "n_check"]
    # A row of queries holds up to 2 * QUERY_POINTS vectors: bound their values.
    values = series.count * max_dim * 2 * QUERY_POINTS * (max_dim + 2)
    small = F.broadcast(queries) if values <= BROADCAST_VALUES else queries
    met = join_on(chunks.select(*keys, "chunk", "xs"), small, series.keys)
    met = met.repartition(max(series.tasks(), series.count * max_dim * (series.longest // TILE + 1) // 256 + 1), *keys, "chunk", "dim")

    @F.pandas_udf(FOUND)
    def nearest(xs: pd.Series, chunk: pd.Series, starts: pd.Series, vectors: pd.Series, dims: pd.Series, taus: pd.Series, limit: pd.Series) -> pd.DataFrame:
        out = {"d": [], "j": [], "ahead": []}
        for x, c, own, vs, dim, tau, top in zip(xs, chunk, starts, vectors, dims, taus, limit):
            count = max(min(TILE, top - c * TILE, len(x) - dim * tau), 0)
            own, points = np.asarray(own), np.stack([np.asarray(v, dtype=float) for v in vs])
            if count == 0:
                out["d"].append(np.full(len(own), np.inf))
                out["j"].append(np.zeros(len(own), dtype="int64"))
                out["ahead"].append(np.zeros(len(own)))
                continue
            x = np.asarray(x, dtype=float)
            squares = np.zeros((len(own), count))
            for k in range(dim):
                gap = points[:, k][:, None] - x[k * tau : k * tau + count][None, :]
                squares += gap * gap
            squares[squares == 0] = np.inf
            at = own - c * TILE
            here = (at >= 0) & (at < count)
            squares[np.nonzero(here)[0], at[here]] = np.inf
            j = squares.argmin(axis=1)
            out["d"].append(np.sqrt(squares[np.arange(len(j)), j]))
            out["j"].append(j + c * TILE)
            out["ahead"].append(x[j + dim * tau])
        return pd.DataFrame(out)

    found = met.select(*[ref(g) for g in group], "q", nearest("xs", "chunk", F.col("q.i"), F.col("q.v"), "dim", "tau", "n_check").alias("__f"))
    own = F.transform("q", lambda q: F.element_at(q["v"], -1))
    lines = found.select(*[ref(g) for g in group], F.posexplode(F.arrays_zip("__f.d", "__f.j", "__f.ahead", own.alias("own"))).alias("__q", "__z"))
    lines = lines.where(F.col("__z.d") < F.lit(float("inf")))
    best = lines.groupBy(*[ref(g) for g in group], "__q").agg(F.min("__z").alias("__z"))
    wrong = F.abs(F.col("__z.own") - F.col("__z.ahead")) / F.col("__z.d") > F.lit(GAP_RATIO)
    shares = best.groupBy(*[ref(g) for g in group]).agg((F.count_if(wrong) / F.count(F.lit(1))).alias("share"))
    return join_on(queries.select(*[ref(g) for g in group]), shares, group, "left").select(
        *[ref(g) for g in group], F.coalesce(F.col("share"), F.lit(0.0)).alias("share")
    )


def false_nearest_neighbours(series: Series, max_dim: int, tau: int | None = None) -> DataFrame:
    """(keys, dim, tau, share) of false neighbours for dimensions 1..max_dim."""
    if max_dim < 1:
        raise InsufficientData(1)
    plan = stored(optimal_delay(series)) if tau is None else series.df.where(F.col("t") == 0).select(*series.key_cols(), "n", F.lit(tau).cast("long").alias("tau"))
    return series.present(false_neighbour_shares(series, plan, max_dim), "dim", "tau", F.col("share").alias("false_share"))


def delay_embedding(series: Series, max_dim: int) -> DataFrame:
    """(keys, optimal_delay, embedding_dimension).

    The dimension is the first with under 1 % false neighbours, else the last
    one that still leaves 20 vectors.
    """
    series.require(50)
    if max_dim < 1:
        raise InsufficientData(1)
    plan = stored(optimal_delay(series))
    tried = false_neighbour_shares(series, plan, max_dim).where(F.col("n_check") >= 20)
    dims = tried.groupBy(*series.key_cols()).agg(
        F.coalesce(F.min(F.when(F.col("share") < FALSE_SHARE, F.col("dim"))), F.max("dim")).alias("dim")
    )
    out = join_on(plan, dims, series.keys, "left")
    return series.present(out, F.col("tau").alias("optimal_delay"), F.coalesce(F.col("dim"), F.lit(1)).alias("embedding_dimension"))
