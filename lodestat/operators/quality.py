"""Missing data and duplicates, on columns of any type."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lodestat.columns import as_list, ref, require_columns
from lodestat.functions.scalars import ratio


def missing(df: DataFrame, columns=None, by=None) -> DataFrame:
    """NULL rows and their share per column."""
    by = as_list(by)
    names = [c for c in df.columns if c not in by] if columns is None else as_list(columns)
    require_columns(df, [*by, *names])
    total = F.count(F.lit(1))
    structs = [
        F.struct(F.lit(c).alias("column"), F.count_if(ref(c).isNull()).alias("missing_count"), ratio(F.count_if(ref(c).isNull()), total).alias("missing_rate"))
        for c in names
    ]
    by_cols = [ref(b) for b in by]
    wide = df.groupBy(*by_cols).agg(F.array(*structs).alias("__a"))
    return wide.select(*by_cols, F.explode("__a").alias("__s")).select(*by_cols, "__s.*")


def missing_count(df: DataFrame, columns=None, by=None) -> DataFrame:
    """NULL rows per column."""
    return missing(df, columns, by).drop("missing_rate")


def missing_rate(df: DataFrame, columns=None, by=None) -> DataFrame:
    """NULL rows over all rows per column."""
    return missing(df, columns, by).drop("missing_count")


def dataset_missing_rate(df: DataFrame) -> DataFrame:
    """NULL cells over all cells."""
    nulls = sum((F.count_if(ref(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(ratio(nulls, F.count(F.lit(1)) * F.lit(len(df.columns))).alias("missing_rate"))


def row_groups(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies (NULL equals NULL)."""
    return df.groupBy(*[ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies.

    Copies merge on the map side, so a row repeated through the whole table
    costs one shuffled record per input partition.
    """
    totals = row_groups(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(F.col("copies") > 1).alias("repeated_groups"),
    )
    return totals.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, with its number of copies."""
    return row_groups(df).where(F.col("copies") > 1)


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Pairs of same-typed columns that agree on every row (NULL equals NULL).

    Order-free checksums sort the columns into classes. Each member is then
    compared with the first of its class, value by value; those that differ
    form a class of their own, until none is left. So the comparisons of a
    pass are fewer than the columns, and a second pass only follows a checksum
    that unequal columns share.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def fingerprint(name: str) -> Column:
        c = ref(name)
        if isinstance(kinds[name], (DoubleType, FloatType)):
            c = c + F.lit(0.0).cast(kinds[name])
        return F.coalesce(F.sum(F.xxhash64(c).cast("decimal(20,0)")), F.lit(0)).alias(name)

    names = df.columns
    sums = df.agg(*[F.struct(fingerprint(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(names):
        groups.setdefault((kinds[c].simpleString(), sums[i][0]), []).append(c)
    open_classes, pairs = [g for g in groups.values() if len(g) > 1], []
    while open_classes:
        tested = [(g[0], c) for g in open_classes for c in g[1:]]
        differ = df.agg(*[F.count_if(~ref(a).eqNullSafe(ref(b))).alias(f"p{i}") for i, (a, b) in enumerate(tested)]).first()
        unequal = {c for i, (_, c) in enumerate(tested) if differ[i]}
        pairs += [p for g in open_classes for p in combinations([c for c in g if c not in unequal], 2)]
        open_classes = [left for g in open_classes if len(left := [c for c in g if c in unequal]) > 1]
    return df.sparkSession.createDataFrame(pairs, "column_a string, column_b string")
