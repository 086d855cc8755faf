"""Linear and nonlinear serial dependence: ACF, PACF, lagged information."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestat.columns import ref
from lodestat.errors import InsufficientData
from lodestat.operators.features import equal_bin, information
from lodestat.plans.joins import broadcast_if, join_on
from lodestat.plans.series import Series, detrended, trend, with_lags


def detrend(series: Series) -> DataFrame:
    """(keys, t, x) with the least-squares line removed."""
    return series.present(detrended(series).df, "t", "x")


def time_reversal_asymmetry(series: Series) -> DataFrame:
    """Mean of ``x_t^2 x_{t-1} - x_t x_{t-1}^2`` per series; 0 below two rows."""
    x, y = F.col("x"), F.col("lag1")
    out = with_lags(series, [1]).groupBy(*series.key_cols()).agg(F.coalesce(F.avg(x * x * y - x * y * y), F.lit(0.0)).alias("asymmetry"))
    return series.present(out, "asymmetry")


def lagged_products(series: Series, max_lag: int) -> DataFrame:
    """(keys, mean, var, acf array) with covariances divided by n."""
    base = trend(series).select(*series.key_cols(), "mean", "var")
    centred = series.attach(series.df, base)
    lagged = with_lags(series, range(1, max_lag + 1), centred)
    mu = F.col("mean")
    sums = [F.sum((F.col("x") - mu) * (F.col(f"lag{k}") - mu)).alias(f"s{k}") for k in range(1, max_lag + 1)]
    out = lagged.groupBy(*series.key_cols()).agg(F.max("n").alias("n"), F.max("var").alias("var"), *sums)
    acf = [F.when(F.col("var") > 0, F.try_divide(F.col(f"s{k}") / F.col("n"), F.col("var"))).otherwise(F.lit(0.0)) for k in range(1, max_lag + 1)]
    return out.select(*series.key_cols(), "n", "var", F.array(*acf).alias("acf"))


def check_lag(series: Series, max_lag: int) -> None:
    """A lag range needs at least one lag and ten rows beyond the last."""
    if max_lag < 1:
        raise InsufficientData(1)
    series.require(max_lag + 10)


def autocorrelation(series: Series, max_lag: int) -> DataFrame:
    """(keys, lag, autocorrelation) for lags 1..max_lag."""
    check_lag(series, max_lag)
    acf = lagged_products(series, max_lag)
    out = acf.select(*series.key_cols(), F.posexplode("acf").alias("__p", "autocorrelation"))
    return series.present(out, (F.col("__p") + 1).alias("lag"), "autocorrelation")


def lag_ranges(series: Series, max_lag: int, first: int = 1) -> DataFrame:
    """(keys, lag, ulo, uhi, vlo, vhi, bins) of the earlier and the later values.

    All lags share the rows at least ``max_lag`` away from both ends, so one
    aggregate covers these and only the end rows are repeated per lag.
    """
    keys = series.key_cols()
    t, n, x = F.col("t"), F.col("n"), F.col("x")
    middle = (t >= max_lag) & (t < n - max_lag)
    inner = series.df.where(middle).groupBy(*keys).agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    ends = series.df.where(~middle).withColumn("lag", F.explode(F.sequence(F.lit(first), F.lit(max_lag))))
    ends = ends.where(F.col("lag") < n)
    earlier, later = F.when(t < n - F.col("lag"), x), F.when(t >= F.col("lag"), x)
    edge = ends.groupBy(*keys, "lag", "n").agg(
        F.min(earlier).alias("ulo"), F.max(earlier).alias("uhi"), F.min(later).alias("vlo"), F.max(later).alias("vhi")
    )
    both = join_on(edge, inner, series.keys, "left")
    bins = F.greatest(F.ceil(F.sqrt((n - F.col("lag")).cast("double"))), F.lit(2))
    low = lambda c: F.least(F.col(c), F.col("__lo")).alias(c)
    high = lambda c: F.greatest(F.col(c), F.col("__hi")).alias(c)
    return both.select(*keys, "lag", low("ulo"), high("uhi"), low("vlo"), high("vhi"), bins.alias("bins"))


def delay_information(series: Series, max_lag: int, first: int = 1) -> DataFrame:
    """(keys, lag, mutual_information) with sqrt(n) bins per lag, from lag ``first`` on.

    The ranges of all lags form one small table. The lagged pairs are binned
    against it, merged on the map side and shuffled as counts.
    """
    lags = list(range(first, max_lag + 1))
    keys = series.key_cols()
    wide = with_lags(series, lags)
    pairs = wide.select(*keys, "t", "x", F.posexplode(F.array(*[F.col(f"lag{k}") for k in lags])).alias("__p", "u"))
    pairs = pairs.withColumn("lag", F.col("__p") + first).where(F.col("t") >= F.col("lag"))
    ranges = broadcast_if(lag_ranges(series, max_lag, first), series.count * len(lags))
    placed = join_on(pairs, ranges, [*series.keys, "lag"])
    flat = (F.col("uhi") == F.col("ulo")) | (F.col("vhi") == F.col("vlo"))
    a = F.when(flat, F.lit(0)).otherwise(equal_bin(F.col("u"), F.col("ulo"), F.col("uhi"), F.col("bins")))
    b = F.when(flat, F.lit(0)).otherwise(equal_bin(F.col("x"), F.col("vlo"), F.col("vhi"), F.col("bins")))
    return information(placed.select(*keys, "lag", a.alias("__a"), b.alias("__b")), [*series.keys, "lag"])


def delay_mutual_information(series: Series, max_lag: int) -> DataFrame:
    """(keys, lag, mutual_information) for lags 1..max_lag."""
    check_lag(series, max_lag)
    return series.present(delay_information(series, max_lag), "lag", "mutual_information")


def dependence_comparison(series: Series, max_lag: int) -> DataFrame:
    """ACF against mutual information per lag, with the nonlinear verdict.

    ``nonlinear_dominance`` holds for a whole series: some lag's information
    exceeds 1.5 times that of a Gaussian pair with the same correlation.
    """
    check_lag(series, max_lag)
    acf = lagged_products(series, max_lag).select(*series.key_cols(), F.posexplode("acf").alias("__p", "r"))
    acf = acf.select(*series.key_cols(), (F.col("__p") + 1).alias("lag"), "r")
    both = join_on(acf, delay_information(series, max_lag), [*series.keys, "lag"])
    gaussian = F.when(F.abs("r") < 1, F.lit(-0.5) * F.ln(F.lit(1.0) - F.col("r") * F.col("r")))
    stronger = F.coalesce(F.col("mutual_information") > gaussian * 1.5, F.lit(False))
    item = F.struct("lag", F.col("r").alias("autocorrelation"), "mutual_information")
    per_series = both.groupBy(*series.key_cols()).agg(F.bool_or(stronger).alias("nonlinear_dominance"), F.sort_array(F.collect_list(item)).alias("__items"))
    out = per_series.select(*series.key_cols(), "nonlinear_dominance", F.explode("__items").alias("__i"))
    return series.present(out, "__i.lag", "__i.autocorrelation", "__i.mutual_information", "nonlinear_dominance")


def partial_from_acf(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of one short ACF array (Durbin-Levinson)."""
    coefficients = np.zeros(0)
    out = np.empty(len(acf))
    for k in range(len(acf)):
        recent = acf[:k][::-1]
        bottom = 1.0 - coefficients @ acf[:k]
        last = (acf[k] - coefficients @ recent) / bottom if abs(bottom) > 1e-15 else 0.0
        coefficients = np.append(coefficients - last * coefficients[::-1], last)
        out[k] = last
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def partial_autocorrelations(acf: pd.Series) -> pd.Series:
    return acf.map(lambda a: partial_from_acf(np.asarray(a, dtype=float)))


def partial_arrays(series: Series, max_lag: int) -> DataFrame:
    """(keys, n, pacf array); one short array per series reaches Python."""
    acf = lagged_products(series, max_lag)
    return acf.select(*series.key_cols(), "n", F.when(F.col("var") == 0, F.array_repeat(F.lit(0.0), max_lag)).otherwise(partial_autocorrelations("acf")).alias("pacf"))


def partial_autocorrelation(series: Series, max_lag: int) -> DataFrame:
    """(keys, lag, partial_autocorrelation) for lags 1..max_lag."""
    check_lag(series, max_lag)
    out = partial_arrays(series, max_lag).select(*series.key_cols(), F.posexplode("pacf").alias("__p", "partial_autocorrelation"))
    return series.present(out, (F.col("__p") + 1).alias("lag"), "partial_autocorrelation")


def memory_profile(series: Series, max_lag: int) -> DataFrame:
    """One row per series: PACF, lagged information, its sum and memory length."""
    check_lag(series, max_lag)
    item = F.struct("lag", "mutual_information")
    info = delay_information(series, max_lag).groupBy(*series.key_cols()).agg(
        F.sort_array(F.collect_list(item)).alias("__items")
    )
    both = join_on(partial_arrays(series, max_lag), info, series.keys)
    marks = F.transform("pacf", lambda p, i: F.when(F.abs(p) > F.lit(2.0) / F.sqrt(F.col("n").cast("double")), i + 1).otherwise(F.lit(0)))
    mi = F.transform("__items", lambda r: r["mutual_information"])
    return series.present(
        both,
        F.col("pacf").alias("partial_autocorrelations"),
        F.aggregate(mi, F.lit(0.0), lambda a, b: a + b).alias("active_information_storage"),
        mi.alias("delay_mutual_informations"),
        F.array_max(marks).alias("memory_length"),
    )
