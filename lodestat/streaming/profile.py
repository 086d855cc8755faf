"""Profiles of event-time windows of a stream.

Everything is an ordinary aggregation keyed by window, so Spark keeps its
mergeable buffers as state: one per window, group and column, dropped once the
watermark has passed the window. A batch DataFrame gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestat.columns import as_list, number, pick, ref, require_columns
from lodestat.functions.scalars import adjusted_skewness, ratio
from lodestat.operators.univariate import zero

#: Statistics whose state does not grow with the rows of a window.
WINDOW_STATISTICS: dict[str, Callable[[Column], Column]] = {
    "rows": lambda c: F.count(F.lit(1)),
    "mean": lambda c: zero(F.avg(c)),
    "variance": lambda c: zero(F.var_samp(c)),
    "skewness": adjusted_skewness,
    "sparsity": lambda c: ratio(F.count_if(c == 0), F.count(F.lit(1))),
}
_BATCH = "batch"


def _windowed(df: DataFrame, ts: str, watermark: str, window: str, slide: str | None, by: Sequence[str], cells: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """Unpivoted rows (window, by, cell fields) and the grouping columns."""
    placed = df.withColumn("__ts", ref(ts).cast("timestamp")).withWatermark("__ts", watermark)
    span = F.window("__ts", window, slide) if slide else F.window("__ts", window)
    rows = placed.select(span.alias("__w"), *[ref(b) for b in by], F.explode(F.array(*cells)).alias("__s"))
    return rows.select("__w", *[ref(b) for b in by], "__s.*"), [F.col("__w"), *[ref(b) for b in by]]


def _shown(by: Sequence[str]) -> list[Column]:
    return [F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[ref(b) for b in by]]


def profile_stream(df: DataFrame, ts: str, window: str, watermark: str, columns=None, by=None, slide: str | None = None) -> DataFrame:
    """Rows, mean, variance, skewness and sparsity per window, group and column.

    ``df`` may be a stream or a table with the timestamp column ``ts``. Rows
    later than ``watermark`` behind the latest event are dropped by Spark; a
    row of an open window counts however late it is. NULL follows the rules of
    the batch operators: skipped by the moments, a row for ``rows`` and
    sparsity. Rows without a timestamp belong to no window.
    """
    by = as_list(by)
    require_columns(df, [ts, *by])
    names = pick(df, columns, by)
    cells = [F.struct(F.lit(c).alias("column"), number(c).alias("__value")) for c in names]
    rows, keys = _windowed(df, ts, watermark, window, slide, by, cells)
    made = [make(F.col("__value")).alias(n) for n, make in WINDOW_STATISTICS.items()]
    return rows.groupBy(*keys, "column").agg(*made).select(*_shown(by), "column", *WINDOW_STATISTICS)


def covariance_stream(df: DataFrame, ts: str, window: str, watermark: str, columns=None, by=None, slide: str | None = None) -> DataFrame:
    """Sample covariance per window and group, NULL deleted pairwise.

    One row per cell of the matrix, both halves; undefined cells are 0. The
    state holds one buffer per cell of the upper half.
    """
    by = as_list(by)
    require_columns(df, [ts, *by])
    names = pick(df, columns, by)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cells = [F.struct(F.lit(i).alias("__i"), F.lit(j).alias("__j"), number(names[i]).alias("__x"), number(names[j]).alias("__y")) for i, j in pairs]
    rows, keys = _windowed(df, ts, watermark, window, slide, by, cells)
    upper = rows.groupBy(*keys, "__i", "__j").agg(zero(F.covar_samp("__x", "__y")).alias("value"))
    place = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    both = F.when(F.col("__i") == F.col("__j"), F.array(place("__i", "__j"))).otherwise(F.array(place("__i", "__j"), place("__j", "__i")))
    out = upper.withColumn("__c", F.explode(both))
    labels = F.array(*[F.lit(c) for c in names])
    at = lambda k: F.col(f"__c.{k}")
    return out.select(*_shown(by), at("i").alias("i"), at("j").alias("j"), labels[at("i")].alias("column_i"), labels[at("j")].alias("column_j"), "value")


def write_closed(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append every window once, when the watermark has passed its end.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes; by default all
    that is there is processed and the query ends.
    """
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def write_current(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the windows that each micro-batch changed, for :func:`current`.

    A batch goes to a folder of its own number, which a repeated attempt
    overwrites: a restart neither loses nor doubles a result.
    """

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_BATCH}={number}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The latest state of every window that :func:`write_current` wrote.

    ``like`` is the result that was written; it gives the schema and the keys.
    """
    values = [c for c in like.columns if c in WINDOW_STATISTICS or c == "value"]
    keys = [ref(c) for c in like.columns if c not in values]
    stored = spark.read.schema(like.schema).option("basePath", path).parquet(path)
    if _BATCH not in stored.columns:
        stored = spark.read.schema(f"{like.schema.toDDL()}, {_BATCH} long").option("basePath", path).parquet(path)
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*[ref(v) for v in values]), F.col(_BATCH)).alias("__v"))
    return last.select(*[ref(c) for c in like.columns if c not in values], "__v.*")
