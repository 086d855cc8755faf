"""Outliers by interquartile range and by z-score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.columns import as_list, number, pick, ref, require_columns
from lodestat.functions.scalars import ratio
from lodestat.operators.univariate import column_stats, quantiles
from lodestat.plans.joins import join_measured, packed_by_column


def count_outside(df: DataFrame, names, by, bounds: DataFrame) -> DataFrame:
    """Count the values outside per-(by, column) bounds ``lower``/``upper``.

    One aggregate over one scan: the bounds enter as constants, or with groups
    as one packed row per group.
    """
    if by:
        source = join_measured(df, packed_by_column(bounds, by, ("lower", "upper"), "__bounds"), by)
        limits = lambda c: F.col("__bounds")[F.lit(c)]
    else:
        fixed = {r["column"]: r for r in bounds.collect()}
        source = df
        limits = lambda c: F.struct(F.lit(fixed[c]["lower"]).alias("lower"), F.lit(fixed[c]["upper"]).alias("upper"))
    structs = []
    for c in names:
        x, lim = number(c), limits(c)
        outside = F.count_if((x < lim["lower"]) | (x > lim["upper"]))
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.max(lim["lower"]).alias("lower"),
                F.max(lim["upper"]).alias("upper"),
                outside.alias("outliers"),
                ratio(outside, F.count(x)).alias("outlier_rate"),
            )
        )
    by_cols = [ref(b) for b in by]
    wide = source.groupBy(*by_cols).agg(F.array(*structs).alias("__a"))
    return wide.select(*by_cols, F.explode("__a").alias("__s")).select(*by_cols, "__s.*")


def iqr_bounds(df: DataFrame, columns=None, by=None, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """``q25 - factor IQR`` and ``q75 + factor IQR`` per column and group."""
    q = quantiles(df, columns, by, approx)
    reach = F.lit(float(factor)) * (F.col("q75") - F.col("q25"))
    return q.select(*[ref(b) for b in as_list(by)], "column", (F.col("q25") - reach).alias("lower"), (F.col("q75") + reach).alias("upper"))


def iqr_outliers(df: DataFrame, columns=None, by=None, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """Bounds, number and share of the values outside them."""
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by)
    return count_outside(df, names, by, iqr_bounds(df, names, by, factor, approx))


def outlier_rate(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Share of non-NULL values outside the interquartile bounds."""
    return iqr_outliers(df, columns, by).select(*[ref(b) for b in as_list(by)], "column", "outlier_rate")


def zscore_bounds(df: DataFrame, columns=None, by=None, z: float = 3.0) -> DataFrame:
    """mean -+ z sample standard deviations."""
    s = column_stats(df, ["mean", "std_dev"], columns, by)
    reach = F.lit(float(z)) * F.col("std_dev")
    return s.select(*[ref(b) for b in as_list(by)], "column", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper"))


def zscore_outliers(df: DataFrame, columns=None, by=None, z: float = 3.0) -> DataFrame:
    """Bounds, number and share of the values more than z deviations away."""
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by)
    return count_outside(df, names, by, zscore_bounds(df, names, by, z))


def outlier_rows(df: DataFrame, column: str, by=None, method: str = "iqr", z: float = 3.0) -> DataFrame:
    """The rows themselves whose ``column`` is an outlier."""
    by = as_list(by)
    bounds = iqr_bounds(df, column, by) if method == "iqr" else zscore_bounds(df, column, by, z)
    outside = lambda lo, hi: (number(column) < lo) | (number(column) > hi)
    if by:
        limits = bounds.select(*[ref(b) for b in by], F.col("lower").alias("__lower"), F.col("upper").alias("__upper"))
        return join_measured(df, limits, by).where(outside(F.col("__lower"), F.col("__upper"))).drop("__lower", "__upper")
    limit = bounds.first()
    return df.where(outside(F.lit(limit["lower"]), F.lit(limit["upper"])))
