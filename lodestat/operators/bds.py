"""Correlation integrals and the BDS test of serial independence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.errors import InsufficientData
from lodestat.functions.scalars import normal_cdf, ratio
from lodestat.plans.boxcount import box_pairs, box_seconds, value_intervals
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.series import Series, detrended, with_lags
from lodestat.plans.tiles import near_pairs, tile_seconds

#: Core seconds of tiles below which boxes are not considered.
SURE_SECONDS = 60


def count_share(pairs: Column, vectors: Column) -> Column:
    """Ordered pairs with self pairs -> share of the unordered pairs."""
    others = pairs.cast("double") - vectors
    return F.when(vectors < 2, F.lit(0.0)).otherwise(ratio(others, vectors * (vectors - 1)))


def boxed_pairs(series: Series, values: DataFrame, dim: int, distinct: int) -> DataFrame:
    """(keys, pairs) by rank boxes: the embedded vectors carry rank intervals."""
    ranked = join_on(series.df, values.select(*series.key_cols(), "x", F.struct("rank", "lo", "hi").alias("spot")), [*series.keys, "x"])
    lags = range(1, dim)
    lagged = with_lags(series, lags, ranked, "spot", "spot").where(F.col("t") >= dim - 1)
    vectors = lagged.select(*series.key_cols(), "n", F.array(*[F.col(f"spot{k}") for k in reversed(lags)], F.col("spot")).alias("v"))
    return box_pairs(series, vectors, dim, distinct)


def counted_values(series: Series, values: DataFrame) -> tuple[DataFrame, int]:
    """The values, stored, and how many different ones a series has at most."""
    values = stored(values)
    return values, values.groupBy(*series.key_cols()).count().agg(F.max("count")).first()[0] or 1


def neighbour_integrals(series: Series, dim: int, epsilon: float, method: str = "auto") -> DataFrame:
    """(keys, n, c1, cm, k): correlation integrals and the triple correlation.

    ``c1`` and ``k`` come from each value's neighbour count; ``cm`` counts
    vectors within boxes (sup-norm, strictly closer than epsilon), by rank
    boxes or by tiles, whichever is estimated cheaper (``method`` overrides).
    """
    keys = series.key_cols()
    values = value_intervals(series, epsilon)
    singles = values.groupBy(*keys).agg(
        F.sum("w").cast("double").alias("n"),
        F.sum(F.col("w") * F.col("near")).alias("__near"),
        F.sum(F.col("w") * F.pow(F.col("near").cast("double"), F.lit(2))).alias("__near2"),
    )
    size = F.col("n")
    vectors = size - (dim - 1)
    if dim == 1:
        counts = singles.select(*keys, F.col("__near").alias("pairs"))
    else:
        widest = None
        if method == "auto":
            # What boxes cost depends on the different values, which are counted only where tiles cost much.
            method, tiled = "tiles", tile_seconds(series.squares)
            if tiled > SURE_SECONDS:
                values, widest = counted_values(series, values)
                method = "tiles" if tiled <= box_seconds(series.rows, widest, dim) else "boxes"
        if method == "tiles":
            near = near_pairs(series, dim, epsilon)
            counts = near.select(*keys, (F.col("near") * 2).alias("__both"))
        else:
            if widest is None:
                values, widest = counted_values(series, values)
            counts = boxed_pairs(series, values, dim, widest)
    both = join_on(singles, counts, series.keys)
    if dim > 1 and method == "tiles":
        both = both.withColumn("pairs", F.col("__both") + vectors)
    return both.select(
        *keys,
        "n",
        count_share(F.col("__near"), size).alias("c1"),
        count_share(F.col("pairs"), vectors).alias("cm"),
        F.when(size < 3, F.lit(0.0)).otherwise(ratio(F.col("__near2"), F.pow(size, F.lit(3)))).alias("k"),
    )


def correlation_integral(series: Series, dim: int, epsilon: float) -> DataFrame:
    """Share of embedded vector pairs closer than epsilon in every coordinate."""
    if dim < 1:
        raise InsufficientData(1)
    series.require(dim)
    return series.present(neighbour_integrals(series, dim, epsilon), F.col("cm").alias("correlation_integral"))


def triple_correlation(series: Series, epsilon: float) -> DataFrame:
    """Mean squared share of points within epsilon of a point, itself included."""
    return series.present(neighbour_integrals(series, 1, epsilon), F.col("k").alias("triple_correlation"))


def bds_test(series: Series, embedding_dim: int, epsilon: float, method: str = "auto") -> DataFrame:
    """BDS statistic and two-sided p-value of the detrended series.

    ``epsilon`` is absolute, in the unit of the series.
    """
    series.require(20)
    if embedding_dim < 2:
        raise InsufficientData(2)
    series.require(embedding_dim + 1)
    m = embedding_dim
    parts = neighbour_integrals(detrended(series), m, epsilon, method)
    c, k = F.col("c1"), F.col("k")
    power = lambda base, e: F.pow(base, F.lit(float(e)))
    middle = sum((power(k, m - j) * power(c, 2 * j) for j in range(1, m)), F.lit(0.0))
    v = F.lit(4.0) * (power(k, m) + 2 * middle + (m - 1) ** 2 * power(c, 2 * m) - m**2 * k * power(c, 2 * (m - 1)))
    stat = F.when(v > 0, F.try_divide(F.sqrt(F.col("n") - m + 1) * (F.col("cm") - power(c, m)), F.sqrt(F.greatest(v, F.lit(0.0)))))
    out = parts.withColumn("statistic", F.coalesce(stat, F.lit(0.0)))
    p = F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs("statistic")))
    return series.present(out, "c1", "cm", "k", "statistic", p.alias("p_value"))
