"""Category counts and class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.columns import as_list, ref, require_columns
from lodestat.functions.scalars import ratio
from lodestat.plans.joins import join_on


def value_counts(df: DataFrame, column: str, by=None) -> DataFrame:
    """(by, __value, __count) with map-side combine, NULL being a value."""
    by = as_list(by)
    require_columns(df, [*by, column])
    return df.groupBy(*[ref(b) for b in by], ref(column).alias("__value")).agg(F.count(F.lit(1)).alias("__count"))


def named(out: DataFrame, by, *columns: str) -> DataFrame:
    """Give the working columns their names; a name that a grouping column has gets an underscore after it."""
    by = as_list(by)
    return out.select(*[ref(b) for b in by], *[F.col(f"__{c}").alias(f"{c}_" if c in by else c) for c in columns])


def top_k_categories(df: DataFrame, column: str, k: int = 10, by=None) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    by = as_list(by)
    counts = value_counts(df, column, by)
    order = [F.col("__count").desc(), F.col("__value").asc()]
    if not by:
        return named(counts.orderBy(*order).limit(k), by, "value", "count")
    rank = F.row_number().over(Window.partitionBy(*[ref(b) for b in by]).orderBy(*order))
    return named(counts.withColumn("__rank", rank).where(F.col("__rank") <= k), by, "value", "count", "rank")


def category_frequency(df: DataFrame, column: str, by=None) -> DataFrame:
    """Every value with its count and share of all rows."""
    by = as_list(by)
    counts = value_counts(df, column, by)
    if by:
        totals = df.groupBy(*[ref(b) for b in by]).agg(F.count(F.lit(1)).alias("__n"))
        shares = join_on(counts, totals, by).withColumn("__share", ratio(F.col("__count"), F.col("__n")))
    else:
        shares = counts.withColumn("__share", ratio(F.col("__count"), df.agg(F.count(F.lit(1))).scalar()))
    return named(shares, by, "value", "count", "share")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """:func:`category_frequency` of the target column."""
    return category_frequency(df, target)


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Largest over smallest class count, NULL labels left out."""
    counts = value_counts(df.where(ref(target).isNotNull()), target)
    return counts.agg(
        F.count(F.lit(1)).alias("classes"),
        F.max("__count").alias("largest"),
        F.min("__count").alias("smallest"),
        ratio(F.max("__count"), F.min("__count")).alias("imbalance_ratio"),
    )
