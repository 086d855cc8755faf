"""Ordered series: dense index, lags and embeddings by chunk.

A series is a set of rows with ``keys`` and an explicit order. Indexing stores
(keys, t, n, x) once; every series operator then works on chunks of at most
:data:`CHUNK` consecutive rows of one series, each extended by the few rows it
needs from its neighbour. One long series is therefore spread like many short
ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.columns import as_list, filled, pick, ref, require_columns
from lodestat.errors import InsufficientData
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import BROADCAST_ROWS, broadcast_if, join_on
from lodestat.plans.ordering import positioned

CHUNK = 8_192


@dataclass(frozen=True)
class Series:
    """Indexed series: ``df`` has the keys, ``t`` (from 0), ``n`` and ``x``.

    ``keys`` are internal columns; ``names`` are the user's, for results.
    """

    df: DataFrame
    keys: list[str]
    names: list[str]
    count: int
    shortest: int
    longest: int
    rows: int
    squares: float

    def key_cols(self) -> list[Column]:
        return [ref(k) for k in self.keys]

    def require(self, length: int) -> None:
        """Raise unless every series has at least ``length`` rows.

        No series at all, as after :meth:`at_least`, gives an empty result.
        """
        if self.shortest < length and (self.count or not self.names):
            raise InsufficientData(length)

    def at_least(self, length: int) -> "Series":
        """Only the series with at least ``length`` rows (an explicit choice)."""
        return measured(self.df.where(F.col("n") >= length), self.keys, self.names)

    def attach(self, df: DataFrame, table: DataFrame) -> DataFrame:
        """Join a table holding one row per series; broadcast within the bound."""
        return join_on(df, broadcast_if(table, self.count), self.keys)

    def with_values(self, value: Column) -> "Series":
        """The same index over another value."""
        return replace(self, df=self.df.withColumn("x", value))

    def tasks(self, factor: float = 1.0, per_task: int = 2_000_000) -> int:
        """Partitions for work on ``rows * factor`` records, at least one per core.

        Adaptive execution sizes partitions by their bytes before a row is
        multiplied, so operators that multiply rows fix the number themselves.
        """
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        return max(cores, int(self.rows * factor // per_task) + 1)

    def present(self, df: DataFrame, *columns: str | Column) -> DataFrame:
        """Result columns behind the user's keys."""
        return df.select(*[ref(k).alias(name) for k, name in zip(self.keys, self.names)], *columns)


def measured(df: DataFrame, keys: list[str], names: list[str]) -> Series:
    """Wrap indexed rows with the number and the lengths of the series."""
    length = F.col("n").cast("double")
    sizes = df.where(F.col("t") == 0).agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.sum("n"), F.sum(length * length)).first()
    return Series(df, keys, names, *[v or 0 for v in sizes])


def index_series(df: DataFrame, column: str, order_by: str | Sequence[str], keys: str | Sequence[str] | None = None) -> Series:
    """Number the rows of every series in ``order_by`` (unique per series).

    NULL values become 0.0. The index is stored, so all operators on the
    result share one sort of the input.
    """
    pick(df, column)
    names, order = as_list(keys), as_list(order_by)
    require_columns(df, [*names, *order])
    keys = [f"__key{i}" for i in range(max(len(names), 1))]
    key_cols = [ref(name).alias(k) for name, k in zip(names, keys)] or [F.lit(0).alias(keys[0])]
    rows = df.select(*key_cols, *[ref(o).alias(f"__o{i}") for i, o in enumerate(order)], filled(column).alias("x"))
    placed, lookup = positioned(rows, keys, [f"__o{i}" for i in range(len(order))])
    indexed = placed.select(*keys, F.col("__pos").alias("t"), F.col("__size").alias("n"), "x")
    return measured(indexed if lookup <= BROADCAST_ROWS else stored(indexed), keys, names)


def with_lags(series: Series, lags: Sequence[int], df: DataFrame | None = None, column: str = "x", prefix: str = "lag") -> DataFrame:
    """Add ``lag<k>`` = the value k rows earlier (NULL before the start).

    Each chunk also receives the last max(lags) rows of the chunk before, so
    one shuffle on (keys, chunk) serves all lags.
    """
    source = series.df if df is None else df
    reach = max(lags, default=0)
    if reach == 0:
        return source
    size = max(CHUNK, reach)
    chunk = F.floor(F.col("t") / size).cast("long")
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))
    copy = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))
    tail = (F.col("t") % size >= size - reach) & (F.col("t") + 1 < F.col("n"))
    spread = source.withColumn("__s", F.explode(F.when(tail, F.array(own, copy)).otherwise(F.array(own))))
    spread = spread.withColumn("__chunk", F.col("__s.chunk")).withColumn("__halo", F.col("__s.halo")).drop("__s")
    window_keys = [*series.key_cols(), F.col("__chunk")]
    spread = spread.repartition(series.tasks(len(lags)), *window_keys)
    order = Window.partitionBy(*window_keys).orderBy("t")
    out = spread.select("*", *[F.lag(column, k).over(order).alias(f"{prefix}{k}") for k in lags])
    return out.where(~F.col("__halo")).drop("__halo", "__chunk")


def embedded(series: Series, dim: int, tau: int, extra: int = 0) -> DataFrame:
    """(keys, i, v, ...): ``v`` = [x_i, x_{i+tau}, ...] of ``dim + extra`` values."""
    length = dim + extra
    lags = [k * tau for k in range(1, length)]
    rows = with_lags(series, lags)
    reach = (length - 1) * tau
    parts = [F.col(f"lag{k}") for k in reversed(lags)] + [F.col("x")]
    return rows.where(F.col("t") >= reach).select(
        *series.key_cols(), (F.col("t") - reach).alias("i"), "n", F.array(*parts).alias("v")
    )


def trend(series: Series) -> DataFrame:
    """Per series: mean, population variance and the least-squares line on t."""
    slope = F.coalesce(F.regr_slope("x", "t"), F.lit(0.0))
    return series.df.groupBy(*series.key_cols()).agg(
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("var"),
        slope.alias("slope"),
        F.coalesce(F.regr_intercept("x", "t"), F.avg("x")).alias("intercept"),
    )


def detrended(series: Series) -> Series:
    """Subtract the least-squares line; a single value stays as it is."""
    line = trend(series).select(*series.key_cols(), "slope", "intercept")
    fitted = F.col("intercept") + F.col("slope") * F.col("t")
    value = F.when(F.col("n") < 2, F.col("x")).otherwise(F.col("x") - fitted)
    rows = series.attach(series.df, line).withColumn("x", value).drop("slope", "intercept")
    return replace(series, df=rows)
