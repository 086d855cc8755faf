"""Per-column profiles: counts, moments, quantiles, sparsity and entropy.

All operators take ``columns`` (default: every numeric feature) and ``by``
(grouping columns) and return one row per column and group. Each statistic is
an aggregate over one scan however many columns there are; exact quantiles
and entropy need one or two more (see :func:`select_ranks`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.columns import as_list, filled, number, numeric_features, pick, ref, require_columns
from lodestat.errors import EmptyDataset
from lodestat.functions.scalars import adjusted_kurtosis, adjusted_skewness, ratio
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import broadcast_if, join_on, packed_by_column
from lodestat.plans.selection import BRACKET_ROWS, Rank, interpolated, interpolation_ranks, select_ranks

QUARTILES = (0.25, 0.5, 0.75)


def zero(c: Column) -> Column:
    """NULL statistic -> 0.0, the result for empty or undefined aggregates."""
    return F.coalesce(c.cast("double"), F.lit(0.0))


# Statistic name -> aggregate over the NULL-skipping view of a column.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "mean": lambda c: zero(F.avg(c)),
    "variance": lambda c: zero(F.var_samp(c)),
    "std_dev": lambda c: zero(F.stddev_samp(c)),
    "min": lambda c: zero(F.min(c)),
    "max": lambda c: zero(F.max(c)),
    "skewness": adjusted_skewness,
    "kurtosis": adjusted_kurtosis,
    "sparsity": lambda c: ratio(F.count_if(c == 0), F.count(F.lit(1))),
    "missing_count": lambda c: F.count_if(c.isNull()),
    "missing_rate": lambda c: ratio(F.count_if(c.isNull()), F.count(F.lit(1))),
    "unique_count": F.count_distinct,
}


def long_view(df: DataFrame, columns: Sequence[str], by: Sequence[str], view: Callable[[str], Column]) -> DataFrame:
    """Unpivot to (by, column, __value), so all columns share one plan."""
    cells = [F.struct(F.lit(c).alias("column"), view(c).alias("__value")) for c in columns]
    return df.select(*[ref(b) for b in by], F.explode(F.array(*cells)).alias("__s")).select(*[ref(b) for b in by], "__s.*")


def column_rows(df: DataFrame, columns: Sequence[str], stats: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """The statistics of all columns, one row per column and group.

    The columns are unpivoted and aggregated by name with map-side combine.
    Hundreds of aggregates side by side in one row would outgrow what the JVM
    compiles; this keeps the generated code the size of one column.
    """
    keys = [*[ref(b) for b in by], F.col("column")]
    out = long_view(df, columns, by, number).groupBy(*keys).agg(*[make(F.col("__value")).alias(n) for n, make in stats.items()])
    if by:
        return out
    # A table without rows still has one line per column.
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(F.broadcast(out), "column", "left").select("column", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in stats])


def column_stats(df: DataFrame, stats: Sequence[str], columns=None, by=None, target: str | None = None) -> DataFrame:
    """Any of :data:`STATISTICS` for the chosen columns."""
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by, target)
    return column_rows(df, names, {s: STATISTICS[s] for s in stats}, by)


def row_count(df: DataFrame, by=None) -> DataFrame:
    """Rows, NULLs included."""
    return df.groupBy(*[ref(b) for b in as_list(by)]).agg(F.count(F.lit(1)).alias("rows"))


def column_types(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numeric features in order with the reported and the Spark type."""
    kinds = dict(df.dtypes)
    data = [(i, c, "f64", kinds[c]) for i, c in enumerate(numeric_features(df, target))]
    return df.sparkSession.createDataFrame(data, "position int, column string, type string, spark_type string")


def column_count(df: DataFrame, target: str | None = None) -> DataFrame:
    """How many numeric features there are."""
    return column_types(df, target).agg(F.count(F.lit(1)).alias("columns"))


def mean(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Mean, NULL skipped; 0 for an empty column."""
    return column_stats(df, ["mean"], columns, by)


def variance(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Sample variance; 0 below two values."""
    return column_stats(df, ["variance"], columns, by)


def skewness(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Adjusted Fisher-Pearson skewness."""
    return column_stats(df, ["skewness"], columns, by)


def kurtosis(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Sample excess kurtosis."""
    return column_stats(df, ["kurtosis"], columns, by)


def std_dev(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Sample standard deviation."""
    return column_stats(df, ["std_dev"], columns, by)


def extrema(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Minimum and maximum."""
    return column_stats(df, ["min", "max"], columns, by)


def sparsity(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Zeros over all rows; NULL is no zero but counts as a row."""
    out = column_stats(df, ["sparsity"], columns, by)
    if not as_list(by) and df.isEmpty():
        raise EmptyDataset("sparsity of a table without rows")
    return out


def unique_count(df: DataFrame, columns=None, by=None, rsd: float | None = None) -> DataFrame:
    """Distinct non-NULL values; with ``rsd`` a HyperLogLog estimate.

    The exact count merges equal values first and counts the merged rows, so
    no task holds a column's distinct values. Works on any column type.
    """
    by = as_list(by)
    require_columns(df, by)
    names = [c for c in (numeric_features(df, exclude=by) if columns is None else as_list(columns))]
    require_columns(df, names)
    if rsd is not None:
        aggs = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(ref(c), rsd).alias("unique_count")) for c in names]
        wide = df.groupBy(*[ref(b) for b in by]).agg(F.array(*aggs).alias("__s"))
        return wide.select(*[ref(b) for b in by], F.explode("__s").alias("__s")).select(*[ref(b) for b in by], "__s.*")
    aggs = [F.count_distinct(ref(c)).alias(f"__u{i}") for i, c in enumerate(names)]
    wide = df.groupBy(*[ref(b) for b in by]).agg(*aggs)
    structs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__u{i}").alias("unique_count")) for i, c in enumerate(names)])
    return wide.select(*[ref(b) for b in by], F.explode(structs).alias("__s")).select(*[ref(b) for b in by], "__s.*")


def moment_statistics() -> dict[str, Column]:
    """Statistics of a column from its sizes and merged sums of powers."""
    n, rows, var = F.col("__present").cast("double"), F.col("__rows"), F.try_divide(F.col("__m2"), F.col("__present"))
    skew = F.when(var > 0, F.try_divide(F.col("__m3"), n * F.pow(var, F.lit(1.5)))).otherwise(F.when(F.isnan(var), var))
    kurt = F.when(var > 0, F.try_divide(F.col("__m4"), n * var * var) - 3).otherwise(F.when(F.isnan(var), var))
    return {
        "count": F.col("__present"),
        "mean": zero(F.col("__mean")),
        "variance": zero(F.when(n > 1, F.col("__m2") / (n - 1))),
        "std_dev": zero(F.when(n > 1, F.sqrt(F.col("__m2") / (n - 1)))),
        "skewness": zero(F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / (n - 2))),
        "kurtosis": zero(F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))),
        "sparsity": ratio(F.col("__zeros"), rows),
        "missing_count": rows - F.col("__present"),
        "missing_rate": ratio(rows - F.col("__present"), rows),
    }


def selected_statistics(selected: DataFrame, by: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """(by, column, min, q25, median, q75, max, others) of a table of selected ranks and merged moments."""
    made = moment_statistics() if others else {}
    out = selected.withColumns({"min": zero(F.col("__min")), "max": zero(F.col("__max"))})
    quartile = [F.coalesce(q, F.col("min")).alias(name) for q, name in zip(interpolated(QUARTILES), ("q25", "median", "q75"))]
    return out.select(*[ref(b) for b in by], "column", "min", *quartile, "max", *[made[o].alias(o) for o in others])


def quantiles(df: DataFrame, columns=None, by=None, approx: bool = False, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Minimum, quartiles (linear interpolation) and maximum, NULL skipped.

    The quartiles are exact, by :func:`select_ranks`; ``approx=True`` takes
    them from its buckets.
    """
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by)
    return selected_statistics(select_ranks(df, names, by, interpolation_ranks(QUARTILES), approx, bracket_rows), by)


def median(df: DataFrame, columns=None, by=None, approx: bool = False) -> DataFrame:
    """The 50 % quantile."""
    return quantiles(df, columns, by, approx).select(*[ref(b) for b in as_list(by)], "column", "median")


#: Quartiles of the histogram rule: plain order statistics of the filled values.
HISTOGRAM_RANKS = [Rank("__q1", lambda n: F.floor(n / 4), True), Rank("__q3", lambda n: F.floor(n * 3 / 4), True)]


def histogram_layout(selected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per column: rows, range, bin count and width of the entropy histogram."""
    gaps, nothing = F.col("__rows") > F.col("__present"), F.lit(0.0)
    low = F.when(gaps, F.least("__least", nothing)).otherwise(F.col("__least"))
    high = F.when(gaps, F.greatest("__most", nothing)).otherwise(F.col("__most"))
    base = selected.select(*[ref(b) for b in by], "column", F.col("__rows").alias("n"), low.alias("lo"), high.alias("hi"), "__q1", "__q3")
    eps = F.lit(2.220446049250313e-16)
    n = F.col("n").cast("double")
    iqr, span = F.col("__q3") - F.col("__q1"), F.col("hi") - F.col("lo")
    by_iqr = F.greatest(F.ceil(F.try_divide(span, F.lit(2.0) * iqr * F.pow(n, F.lit(-1.0 / 3.0)))).cast("double"), F.lit(2.0))
    by_count = F.ceil(F.log2(n)).cast("double") + 1
    bins = F.when(iqr > eps, by_iqr).otherwise(by_count)
    return base.select(*[ref(b) for b in by], "column", "n", "lo", "hi", (span < eps).alias("constant"), bins.alias("bins"), (span / bins).alias("width"))


def binned_entropy(df: DataFrame, names: Sequence[str], by: Sequence[str], layout: DataFrame) -> DataFrame:
    """(by, column, bins, entropy): one ``groupBy(column, bin)``, so its shuffle carries bins and not rows."""
    by_cols = [ref(b) for b in by]
    fields = ("n", "lo", "width", "bins", "constant")
    if by:
        packed = stored(packed_by_column(layout, by, fields, "__lay"))
        attach = lambda t: join_on(t, broadcast_if(packed, packed.count()), by)
        source, place = attach(df.select(*by_cols, *[ref(c) for c in names if c not in by])), (lambda c: F.col("__lay")[c])
    else:
        fixed = {r["column"]: r for r in layout.collect()}
        if not all(r["n"] for r in fixed.values()):
            raise EmptyDataset("entropy of a table without rows")
        pack = lambda r: F.struct(*[F.lit(r[f]).cast("boolean" if f == "constant" else "double").alias(f) for f in fields])
        packed = F.create_map(*[e for c in names for e in (F.lit(c), pack(fixed[c]))])
        attach = lambda t: t.withColumn("__lay", packed)
        source, place = df, (lambda c: pack(fixed[c]))
    cells = []
    for c in names:
        lay = place(c)
        raw = F.floor(F.try_divide(filled(c) - lay["lo"], lay["width"])).cast("double")
        spot = F.when(lay["constant"] | F.isnan(filled(c)), F.lit(0.0)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), lay["bins"] - 1))
        cells.append(F.struct(F.lit(c).alias("column"), spot.alias("bin")))
    binned = source.select(*by_cols, F.explode(F.array(*cells)).alias("__s")).select(*by_cols, "__s.*")
    counts = attach(binned.groupBy(*by_cols, "column", "bin").agg(F.count(F.lit(1)).alias("__c")))
    lay = F.col("__lay")[F.col("column")]
    share = F.col("__c") / lay["n"]
    term = F.when(lay["width"] > 0, -share * F.ln(share / lay["width"])).otherwise(F.lit(0.0))
    return counts.groupBy(*by_cols, "column").agg(F.max(lay["bins"]).cast("long").alias("bins"), F.sum(term).alias("entropy"))


def entropy(df: DataFrame, columns=None, by=None, approx: bool = False, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Differential entropy (nats) from a Freedman-Diaconis histogram.

    NULL counts as 0.0. Sturges' rule replaces the bin rule when the quartiles
    coincide; a constant column has entropy 0. ``approx=True`` takes the
    quartiles that set the number of bins from buckets.
    """
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by)
    selected = select_ranks(df, names, by, HISTOGRAM_RANKS, approx, bracket_rows)
    return binned_entropy(df, names, by, histogram_layout(selected, by))


PROFILE_STATISTICS = ("count", "missing_count", "missing_rate", "mean", "variance", "std_dev", "skewness", "kurtosis", "sparsity")


def profile(df: DataFrame, columns=None, by=None, target: str | None = None, approx: bool = False, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Every univariate statistic, one row per column (and group), in three scans.

    The first counts buckets and takes their moments, the second the quartiles
    inside their buckets, the third the histogram; ``approx=True`` leaves out
    the second.
    """
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by, target)
    selected = select_ranks(df, names, by, [*interpolation_ranks(QUARTILES), *HISTOGRAM_RANKS], approx, bracket_rows, moments=True)
    out = selected_statistics(selected, by, PROFILE_STATISTICS)
    out = join_on(out, binned_entropy(df, names, by, histogram_layout(selected, by)), [*by, "column"])
    order = ["count", "missing_count", "missing_rate", "mean", "variance", "std_dev", "min", "q25", "median", "q75", "max", "skewness", "kurtosis", "sparsity", "entropy"]
    return out.select(*[ref(b) for b in by], "column", *order)
