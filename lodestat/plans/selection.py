"""Exact order statistics of many columns and groups without sorting them.

The first scan counts values in buckets of a monotone key, a sketch that merges
by addition. Running totals over the few buckets of a column say which of them
holds a wanted rank and exactly how many values lie below it. A bucket that
holds many values is cut again, between its own extremes. The last scan ships
only the values of the buckets that are left, merged where equal, and the ranks
are read off these short lists. Nothing is estimated, so no rank is missed, and
a column costs two scans, however large it is, or a few where its values crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.columns import number, ref
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import broadcast_if, join_on

#: Buckets for each doubling of a value, and parts of a bucket that is cut again.
PER_OCTAVE, PARTS = 256, 1_024
#: Values of a bucket that is not cut again, and how often it may be.
BRACKET_ROWS, PASSES = 65_536, 8
#: Beyond the logarithm of any double, times PER_OCTAVE.
_ORIGIN = 300_000


@dataclass(frozen=True)
class Rank:
    """A wanted order statistic: ``of`` gives the 0-based rank from the number of values.

    Over ``filled`` values NULL is 0.0, else it is left out. NaN is the
    greatest value.
    """

    name: str
    of: Callable[[Column], Column]
    filled: bool = False


def bucket(v: Column) -> Column:
    """Bucket number: never falls as the value rises; NULL for NULL."""
    size = F.floor(F.least(F.log2(F.abs(v)) * PER_OCTAVE, F.lit(float(_ORIGIN)))) + _ORIGIN
    return F.when(F.isnan(v), 3 * _ORIGIN).when(v > 0, size).when(v < 0, -size).when(v == 0, 0)


#: What the first scan keeps of every bucket, besides its rows.
_PER_BUCKET = {"c": F.count, "lo": F.min, "hi": F.max}
_BUCKET_MOMENTS = {"mean": F.avg, "var": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis}


def _moments() -> dict[str, Column]:
    """Merged aggregates of a column's buckets; ``gap`` is a bucket's mean minus the column's."""
    n, gap = F.col("c").cast("double"), F.col("gap")
    var, zero = F.coalesce("var", F.lit(0.0)), F.lit(0.0)
    second = var * n
    third = F.when(var == 0, zero).otherwise(F.col("skew") * n * F.pow(var, F.lit(1.5)))
    fourth = F.when(var == 0, zero).otherwise((F.col("kurt") + 3) * n * var * var)
    return {
        "__m2": F.sum(F.when(n > 0, second + n * gap * gap)),
        "__m3": F.sum(F.when(n > 0, third + 3 * gap * second + n * gap * gap * gap)),
        "__m4": F.sum(F.when(n > 0, fourth + 4 * gap * third + 6 * gap * gap * second + n * gap * gap * gap * gap)),
    }


def _values(df: DataFrame, names: Sequence[str], by: Sequence[str], spans: DataFrame | None = None) -> DataFrame:
    """(by, column, __value) of all cells; with ``spans`` only of values inside one, and its ends ``__lo`` and ``__hi``.

    A value finds the spans of its bucket by a join, so the code that runs per value stays the same however many there are.
    """
    keys, v = [ref(b) for b in by], F.col("__value")
    cells = [F.struct(F.lit(c).alias("column"), number(c).alias("__value")) for c in names]
    out = df.select(*keys, F.explode(F.array(*cells)).alias("__s")).select(*keys, "__s.*")
    if spans is None:
        return out
    met = join_on(out.withColumn("__b", bucket(v)), broadcast_if(spans, spans.count()), [*by, "column", "__b"])
    return met.where((v >= F.col("__lo")) & (v <= F.col("__hi"))).drop("__b")


def _running(group: Sequence[Column], order: str) -> Column:
    """Sum of ``c`` over the earlier lines of the group."""
    return F.sum("c").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")


def _hit(lines: DataFrame, aims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The line of its bucket that holds each rank: ``lines`` with ``before``, of the buckets from ``__lo`` on."""
    met = join_on(aims.where("lo < hi").withColumn("__lo", F.col("lo")), lines, [*keys, "__lo"])
    spot = F.col("below") + F.col("before")
    return met.where((spot <= F.col("target")) & (F.col("target") < spot + F.col("c")))


def _spans(aims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(by, column, __b, __lo, __hi): the different parts of buckets that are not a single value, and the buckets."""
    lo, hi = F.col("lo"), F.col("hi")
    return aims.where("lo < hi").select(*[ref(k) for k in keys], bucket(lo).alias("__b"), lo.alias("__lo"), hi.alias("__hi")).distinct()


def _narrowed(df: DataFrame, names: Sequence[str], by: Sequence[str], aims: DataFrame) -> DataFrame:
    """``aims`` with the part of each bucket that holds the rank in place of the bucket."""
    keys = [*by, "column"]
    key_cols = [ref(k) for k in keys]
    low, high = F.col("__lo"), F.col("__hi")
    part = F.least(F.floor((F.col("__value") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
    cells = _values(df, names, by, stored(_spans(aims, keys)))
    lines = cells.groupBy(*key_cols, "__lo", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("__value").alias("least"), F.max("__value").alias("most"))
    lines = lines.withColumn("before", _running([*key_cols, low], "part"))
    cut = _hit(lines, aims, keys).select(*key_cols, "i", "target", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("held"))
    return aims.where("lo = hi").unionByName(cut)


def _picked(df: DataFrame, names: Sequence[str], by: Sequence[str], aims: DataFrame) -> DataFrame:
    """(by, column, i, value): what stands at each rank."""
    keys = [*by, "column"]
    key_cols = [ref(k) for k in keys]
    lines = _values(df, names, by, stored(_spans(aims, keys))).groupBy(*key_cols, "__lo", "__value").agg(F.count(F.lit(1)).alias("c"))
    lines = lines.withColumn("before", _running([*key_cols, F.col("__lo")], "__value"))
    found = _hit(lines, aims, keys).select(*key_cols, "i", F.col("__value").alias("value"))
    return found.unionByName(aims.where("lo = hi").select(*key_cols, "i", F.col("lo").alias("value")))


def select_ranks(df: DataFrame, names: Sequence[str], by: Sequence[str], ranks: Sequence[Rank], approx: bool = False, bracket_rows: int = BRACKET_ROWS, moments: bool = False) -> DataFrame:
    """One row per column and group: sizes, extremes, the wanted ranks and, if asked for, moments.

    Columns: by, column, ``__rows``, ``__present`` (not NULL), ``__zeros``,
    ``__min``, ``__max``, ``__least``, ``__most`` (without NaN), one per rank,
    NULL where there is no value, and for ``moments`` ``__mean``, ``__m2``,
    ``__m3``, ``__m4`` (the sums of powers of deviations). ``approx``
    interpolates inside the bucket, off by at most 0.3 % of the value, and
    needs no second scan.
    """
    shown = {f"__by{k}": b for k, b in enumerate(by)}  # working names, which no grouping column can meet
    df = df.withColumns({k: ref(b) for k, b in shown.items()}) if by else df
    by, keys = list(shown), [*shown, "column"]
    key_cols = [ref(k) for k in keys]
    v, b = F.col("__value"), F.col("b")
    kept = _PER_BUCKET | (_BUCKET_MOMENTS if moments else {})
    lines = _values(df, names, by).groupBy(*key_cols, bucket(v).alias("b")).agg(F.count(F.lit(1)).alias("rows"), *[make(v).alias(n) for n, make in kept.items()])
    if moments:
        whole = Window.partitionBy(*key_cols)
        centre = F.try_divide(F.sum(F.col("c") * F.col("mean")).over(whole), F.sum("c").over(whole))
        lines = lines.withColumn("centre", centre).withColumn("gap", F.col("mean") - F.col("centre"))
    lines = stored(lines.withColumn("before", _running(key_cols, "b")))
    nan = b == 3 * _ORIGIN
    counted = lambda where: F.sum(F.when(where, F.col("c")).otherwise(0))
    sizes = {
        "__rows": F.sum("rows"),
        "__present": F.sum("c"),
        "__zeros": counted(b == 0),
        **({"__mean": F.max("centre"), **_moments()} if moments else {}),
        "__min": F.min("lo"),
        "__max": F.max("hi"),
        "__least": F.min(F.when(~nan, F.col("lo"))),
        "__most": F.max(F.when(~nan, F.col("hi"))),
    }
    extra = [counted(b < 0).alias("negative"), counted(~nan).alias("clean")]
    table = lines.groupBy(*key_cols).agg(*[c.alias(n) for n, c in sizes.items()], *extra)
    wanted, missing = [], F.col("__rows") - F.col("__present")
    for i, rank in enumerate(ranks):
        total = F.col("__rows") if rank.filled else F.col("__present")
        at = rank.of(total).cast("long")
        known = F.when(total == 0, None)
        if rank.filled:  # the zeros that stand for NULL lie right behind the negative values
            known = F.when((at >= F.col("negative")) & (at < F.col("negative") + missing), F.lit(0.0))
            at = F.when(at < F.col("negative"), at).otherwise(at - missing)
        known = known.when(at >= F.col("clean"), F.when(F.col("__present") > F.col("clean"), F.lit(float("nan"))))
        target = F.when((at < F.col("clean")) & known.isNull(), at)
        wanted.append(F.struct(F.lit(i).alias("i"), target.alias("target"), known.cast("double").alias("known")))
    table = stored(table.select(*key_cols, *sizes, F.array(*wanted).alias("wanted")))

    held = F.col("b").isNotNull()
    met = join_on(lines.where(held).select(*key_cols, "lo", "hi", F.col("before").alias("below"), F.col("c").alias("held")), table.select(*key_cols, "wanted"), keys)
    met = met.withColumn("w", F.explode(F.filter("wanted", lambda w: (w["target"] >= F.col("below")) & (w["target"] < F.col("below") + F.col("held")))))
    aims = stored(met.select(*key_cols, F.col("w.i").alias("i"), F.col("w.target").alias("target"), "lo", "hi", "below", "held"))
    if approx:
        part = (F.col("target") - F.col("below")) / F.col("held")
        found = aims.select(*key_cols, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("value"))
    else:
        largest = lambda t: t.where("lo < hi").agg(F.max("held")).first()[0] or 0
        for _ in range(PASSES):
            if largest(aims) <= bracket_rows:
                break
            aims = stored(_narrowed(df, names, by, aims))
        found = _picked(df, names, by, aims)
    packed = found.groupBy(*key_cols).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("__at"))
    known = lambda i: F.get("wanted", F.lit(i))["known"]
    values = [F.coalesce(known(i), F.col("__at")[F.lit(i)]).alias(r.name) for i, r in enumerate(ranks)]
    out = stored(join_on(table, packed, keys, "left").select(*key_cols, *sizes, *values))
    if by:
        return out.withColumnsRenamed(shown)
    # A table without rows still has one line per column.
    listed = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    zeros = [F.coalesce(n, F.lit(0)).alias(n) for n in ("__rows", "__present", "__zeros")]
    rest = [n for n in sizes if n not in ("__rows", "__present", "__zeros")]
    return listed.join(F.broadcast(out), "column", "left").select("column", *zeros, *rest, *[ref(r.name) for r in ranks])


def interpolation_ranks(shares: Sequence[float]) -> list[Rank]:
    """The neighbours of every share's linearly interpolated quantile."""
    spot = lambda n, p: (n - 1) * F.lit(float(p))
    ranks = []
    for i, p in enumerate(shares):
        ranks.append(Rank(f"__before{i}", lambda n, p=p: F.greatest(F.floor(spot(n, p)), F.lit(0))))
        ranks.append(Rank(f"__after{i}", lambda n, p=p: F.greatest(F.ceil(spot(n, p)), F.lit(0))))
    return ranks


def interpolated(shares: Sequence[float]) -> list[Column]:
    """The quantiles from the columns that :func:`interpolation_ranks` made."""
    out = []
    for i, p in enumerate(shares):
        spot = (F.col("__present") - 1) * F.lit(float(p))
        low, high = F.col(f"__before{i}"), F.col(f"__after{i}")
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot))))
    return out
