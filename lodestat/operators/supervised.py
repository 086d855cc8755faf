"""Feature/label split for supervised learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.columns import as_list, filled, numeric_features, ref
from lodestat.errors import ColumnNotFound, InvalidPredictionTask, NotEnoughColumns

PREDICTION_TYPES = ("regression", "binary_classification", "multi_category")


def design_matrix_and_target(df: DataFrame, target_column: str, prediction_type: str, keep=None, target: str | None = None) -> DataFrame:
    """``keep`` columns, ``features array<double>`` and ``label double``.

    ``target`` is a target already set aside from the feature list, as when a
    table is loaded with one. NULL becomes 0.0 in features and label, so a
    NULL label is label 0. Classification checks its number of labels.
    """
    keep = as_list(keep)
    listed = [c for c in numeric_features(df, target) if c not in keep]
    if target_column not in listed and not (target_column == target and target_column in numeric_features(df)):
        raise ColumnNotFound(target_column)
    if prediction_type not in PREDICTION_TYPES:
        raise InvalidPredictionTask(f"unknown prediction type: {prediction_type}")
    features = [c for c in listed if c != target_column]
    if len(listed) < 2 or not features:
        raise NotEnoughColumns("a split needs two numeric columns in the feature list")
    out = df.select(*[ref(k) for k in keep], F.array(*[filled(c) for c in features]).alias("features"), filled(target_column).alias("label"))
    if prediction_type != "regression":
        found = out.select("label").distinct().limit(3).count()
        binary = prediction_type == "binary_classification"
        if (binary and found != 2) or (not binary and found < 3):
            need = "exactly 2" if binary else "at least 3"
            raise InvalidPredictionTask(f"{prediction_type} requires {need} distinct labels, found {found}{' or more' if found == 3 else ''}")
    return out


def feature_names(df: DataFrame, target_column: str, keep=None, target: str | None = None) -> list[str]:
    """The order of the ``features`` array of :func:`design_matrix_and_target`."""
    keep = as_list(keep)
    return [c for c in numeric_features(df, target) if c not in keep and c != target_column]
