"""Positions and running totals in a global order, without a global window.

Rows are range-partitioned on ``groups + order``, sorted inside their partition
and numbered while they stream by, weights summed up likewise. They are stored
like that, once. What a group has in earlier partitions comes from a table with
one line per group and partition, which is broadcast within the usual bound, so
nothing is shuffled after the range sort. A group that holds most of the rows
simply spans many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lodestat.columns import ref
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import broadcast_if, join_on

# Bits of the row number inside a partition in monotonically_increasing_id.
PARTITION_BIT = 33


def summed_up(columns: Sequence[str]):
    """Arrow function: add ``__run<k>``, the sum of a column over the partition's earlier rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(columns)
        for batch in batches:
            for k, name in enumerate(columns):
                total = carried[k] + np.cumsum(batch.column(name).to_numpy())
                batch = batch.append_column(f"__run{k}", pa.array(total - batch.column(name).to_numpy()))
                carried[k] = int(total[-1]) if len(total) else carried[k]
            yield batch

    return run


def positioned(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], weight: str | None = None, also: str | None = None) -> tuple[DataFrame, int]:
    """The result of :func:`with_position` and the size of the table it looks up."""
    group_cols = [ref(g) for g in groups]
    order_cols = [ref(o) if isinstance(o, str) else o for o in order]
    weights = [w for w in (weight, also) if w]
    rows = df.withColumns({w: ref(w).cast("long") for w in weights}) if weights else df
    rows = rows.repartitionByRange(*group_cols, *order_cols).sortWithinPartitions(*group_cols, *order_cols)
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    if weights:
        sums = [StructField(f"__run{k}", LongType()) for k in range(len(weights))]
        rows = rows.mapInArrow(summed_up(weights), StructType([*rows.schema.fields, *sums]))
    placed = stored(rows)

    part = F.shiftright("__at", PARTITION_BIT)
    earlier = Window.partitionBy(*group_cols).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group_cols)
    runs = [F.struct(F.min(f"__run{k}").alias("first"), F.sum(ref(w)).alias("sum")).alias(f"__w{k}") for k, w in enumerate(weights)]
    lines = placed.groupBy(*group_cols, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"), *runs)
    moves = [(F.sum("__n").over(earlier) - F.col("__n") - F.col("__first")).alias("__move"), F.sum("__n").over(whole).alias("__size")]
    for k in range(len(weights)):
        of = f"__w{k}.sum"
        moves.append((F.sum(of).over(earlier) - F.col(of) - F.col(f"__w{k}.first")).alias(f"__move{k}"))
        if not k:
            moves.append(F.sum(of).over(whole).alias("__total"))
    lines = stored(lines.select(*group_cols, "__part", *moves))
    size = lines.count()
    out = join_on(placed.withColumn("__part", part), broadcast_if(lines, size), [*groups, "__part"])
    made = {"__pos": (F.col("__at") + F.col("__move")).cast("long")}
    for k, name in enumerate(("__before", "__before_also")[: len(weights)]):
        made[name] = F.col(f"__run{k}") + F.col(f"__move{k}")
    spent = ["__part", "__at", "__move", *[f"{c}{k}" for k in range(len(weights)) for c in ("__run", "__move")]]
    return out.withColumns(made).drop(*spent), size


def with_position(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], weight: str | None = None, also: str | None = None) -> DataFrame:
    """Add ``__pos`` (0-based), ``__size`` and, for a weight, ``__before``/``__total``.

    ``__pos`` numbers the rows of each group in ``order``; ``__size`` is the
    group's row count. ``__before`` is the weight of the earlier rows and
    ``__total`` the weight of the whole group; ``also`` names a second weight
    with ``__before_also``. Weights are whole numbers of at least 0. ``order``
    must be unique within a group.
    """
    return positioned(df, groups, order, weight, also)[0]


def ranked_values(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct (group, value) with its weight and position.

    Columns: groups, ``value``, ``__w`` (rows or summed weight) and those of
    :func:`with_position`: ``__pos`` is the dense rank, ``__before`` counts the
    rows below the value. Equal values are merged before anything is sorted.
    """
    total = F.sum(ref(weight)) if weight else F.count(F.lit(1))
    counted = df.groupBy(*[ref(g) for g in groups], ref(value)).agg(total.alias("__w"))
    return with_position(counted, groups, [value], weight="__w")
