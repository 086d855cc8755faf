"""Choosing columns and the two views of a numeric column.

Two views exist because missing values are handled in two ways:

* :func:`number` keeps NULL, so aggregates skip it (moments, quantiles,
  covariance, sparsity);
* :func:`filled` replaces NULL by 0.0 (entropy, principal components, the
  feature/label split and every series operator).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodestat.errors import ColumnNotFound


def ref(name: str) -> Column:
    """Reference a column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as double, NULL kept."""
    return ref(name).cast("double")


def filled(name: str) -> Column:
    """The column as double with NULL replaced by 0.0."""
    return F.coalesce(number(name), F.lit(0.0))


def numeric_features(df: DataFrame, target: str | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order, without the target and ``exclude``."""
    skip = set(exclude) | ({target} if target is not None else set())
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def pick(df: DataFrame, columns: str | Sequence[str] | None, by: Sequence[str] = (), target: str | None = None) -> list[str]:
    """Resolve ``columns`` (one name, several, or None for all numeric features)."""
    if columns is None:
        return numeric_features(df, target, by)
    names = [columns] if isinstance(columns, str) else list(columns)
    known = set(numeric_features(df))
    for name in names:
        if name not in known:
            raise ColumnNotFound(name)
    return names


def as_list(names: str | Sequence[str] | None) -> list[str]:
    """Normalise an optional name or list of names to a list."""
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise :class:`ColumnNotFound` for the first name absent from ``df``."""
    for name in names:
        if name not in df.columns:
            raise ColumnNotFound(name)
