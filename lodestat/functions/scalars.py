"""Scalar column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz & Stegun 7.1.26 error function
# approximation, lowest power of t first, and its t = 1 / (1 + P x) constant.
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Division that yields ``default`` where the denominator is zero or NULL."""
    out = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (absolute error about 1e-7)."""
    u = F.abs(x) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * u)
    poly = F.lit(0.0)
    for c in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(c)) * t
    erf = F.lit(1.0) - poly * F.exp(-u * u)
    return F.lit(0.5) * (F.lit(1.0) + F.when(x >= 0, erf).otherwise(-erf))


def adjusted_skewness(c: Column) -> Column:
    """Aggregate: sample skewness G1; 0 below three values or for a constant."""
    n = F.count(c).cast("double")
    scale = F.sqrt(n * (n - 1)) / (n - 2)
    return F.coalesce(F.when(F.count(c) >= 3, F.skewness(c) * scale), F.lit(0.0))


def adjusted_kurtosis(c: Column) -> Column:
    """Aggregate: sample excess kurtosis G2; 0 below four values or for a constant."""
    n = F.count(c).cast("double")
    scale = (n - 1) / ((n - 2) * (n - 3))
    value = scale * ((n + 1) * F.kurtosis(c) + 6)
    return F.coalesce(F.when(F.count(c) >= 4, value), F.lit(0.0))
