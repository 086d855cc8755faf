"""Equality joins that keep NULL keys and check sizes before broadcasting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.columns import ref
from lodestat.plans.checkpoints import stored

# Broadcast a lookup table only up to this many rows; beyond it, join by shuffle.
BROADCAST_ROWS = 100_000


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the known row count is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL matching NULL, and keep the left key columns."""
    renamed = right.select(
        *[ref(k).alias(f"__right_{k}") for k in keys],
        *[ref(c) for c in right.columns if c not in keys],
    )
    condition = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"__right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def join_measured(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a per-group table, broadcast only after counting its stored rows.

    Beyond the bound the join shuffles, and adaptive execution splits the
    partitions of hot groups.
    """
    kept = stored(table)
    return join_on(df, broadcast_if(kept, kept.count()), keys)


def packed_by_column(table: DataFrame, by: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """One row per group: a map from ``column`` to a struct of ``fields``."""
    entries = F.collect_list(F.struct(F.col("column"), F.struct(*fields)))
    return table.groupBy(*[ref(b) for b in by]).agg(F.map_from_entries(entries).alias(name))
