"""Rounding used on both sides of a comparison with another engine.

Summation order differs between engines, so results are compared to nine
significant digits, or to fixed decimals where values are near zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def significant(c: Column) -> Column:
    places = F.lit(8) - F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0)))))
    fine, coarse = F.pow(F.lit(10.0), places), F.pow(F.lit(10.0), -places)
    return F.when(c == 0, F.lit(0.0)).when(places >= 0, F.round(c * fine) / fine).otherwise(F.round(c / coarse) * coarse)


def rounded(df: DataFrame, sig=(), **decimals: int) -> DataFrame:
    """Round the ``sig`` columns to nine digits and others to fixed decimals."""
    out = []
    for c in df.columns:
        if c in sig:
            out.append(significant(F.col(c)).alias(c))
        elif c in decimals:
            out.append((F.round(F.col(c), decimals[c]) + F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def sig_sql(x: str) -> str:
    """SQL text of :func:`significant`."""
    places = f"(8 - floor(log10(abs(nullif(({x})::double, 0)))))"
    fine, coarse = f"power(10.0::double, {places})", f"power(10.0::double, -{places})"
    return (
        f"(case when ({x}) = 0 then 0.0::double when {places} >= 0 then round(({x}) * {fine}) / {fine}"
        f" else round(({x}) / {coarse}) * {coarse} end)"
    )


def dec_sql(x: str, digits: int) -> str:
    """SQL text of fixed-decimal rounding."""
    return f"(round(({x})::double, {digits}) + 0.0)"
