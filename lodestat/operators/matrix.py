"""Covariance, correlation and principal components.

The distributed part is one aggregation that yields the m x m covariance; the
m x m eigenproblem is solved on the driver, and projections are column
expressions over its constants.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.columns import as_list, filled, number, pick, ref, require_columns
from lodestat.errors import NotEnoughColumns
from lodestat.functions.scalars import ratio

# Matrix cells that a task holds for its groups before it hands the sums on.
HELD_CELLS = 1 << 20
# Largest number of multiply-adds written out as column expressions per row.
EXPRESSION_TERMS = 2_000


def gram_sums(width: int, keys: Sequence[str], shift: np.ndarray):
    """Arrow function: products of the batches, summed per group, one row per group and matrix row.

    A cell adds up over the rows where both columns are present. ``bad`` counts
    those with NaN or an infinity in either, which make the covariance NaN.
    """

    def rows(states: dict) -> dict[str, list]:
        columns = {k: [] for k in (*keys, "i", "n", "xy", "x", "y", "bad")}
        for key, sums in states.items():
            for i in range(width):
                for k, value in zip(keys, key):
                    columns[k].append(value)
                columns["i"].append(i)
                for name, total in zip(("n", "xy", "x", "y", "bad"), sums):
                    columns[name].append(total[i, i:])
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, np.ndarray] = {}
        types: list[pa.Field] = []

        def flushed() -> pa.RecordBatch:
            columns = rows(states)
            states.clear()
            kinds = {f.name: f.type for f in types} | {"i": pa.int32()}
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.list_(pa.float64()))) for c, v in columns.items()})

        for batch in batches:
            types = [batch.schema.field(k) for k in keys]
            cells = [batch.column(f"c{j}") for j in range(width)]
            present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cells], axis=1).astype(float)
            values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cells], axis=1)
            wrong = ~np.isfinite(values)
            centred = np.where(wrong | (present == 0), 0.0, values - shift)
            wrong = wrong.astype(float)
            group = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
            for low, high in zip(cuts, cuts[1:]):
                at = order[low:high]
                p, c, w = present[at], centred[at], wrong[at]
                sums = np.stack([p.T @ p, c.T @ c, c.T @ p, p.T @ c, w.T @ p + p.T @ w])
                key = tuple(batch.column(k)[int(at[0])].as_py() for k in keys)
                states[key] = states[key] + sums if key in states else sums
            if len(states) * width * width > HELD_CELLS:
                yield flushed()
        if states:
            yield flushed()

    return run


def upper_triangle(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, cells): the upper triangle of each group's covariance, pairwise without NULL.

    Tasks multiply their batches into sums of mean-shifted products and emit
    one row per group and matrix row; rows never leave their partition, and
    the same path serves any width. Undefined cells are 0.
    """
    m, keys = len(names), [f"k{k}" for k in range(len(by))]
    finite = lambda c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) < F.lit(float("inf"))), number(c))
    means = df.agg(*[F.coalesce(F.avg(finite(c)), F.lit(0.0)).alias(f"c{j}") for j, c in enumerate(names)]).first()
    shift = np.nan_to_num(np.array(list(means), dtype=float), posinf=0.0, neginf=0.0)
    source = df.select(*[ref(b).alias(k) for b, k in zip(by, keys)], *[number(c).alias(f"c{j}") for j, c in enumerate(names)])
    kinds = [f"{k} {source.schema[k].dataType.simpleString()}" for k in keys]
    sums = ("n", "xy", "x", "y", "bad")
    partial = source.mapInArrow(gram_sums(m, keys, shift), ", ".join([*kinds, "i int", *[f"{s} array<double>" for s in sums]]))
    flat = partial.select(*keys, "i", F.posexplode(F.arrays_zip(*sums)).alias("__p", "__z")).select(*keys, "i", (F.col("i") + F.col("__p")).alias("j"), "__z.*")
    flat = flat.groupBy(*keys, "i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    value = F.when(F.col("n") > 1, F.when(F.col("bad") > 0, F.lit(float("nan"))).otherwise((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)))
    cells = flat.select(*keys, "i", "j", F.coalesce(value, F.lit(0.0)).alias("value"))
    if not by:  # a table without rows still has every cell
        listed = df.sparkSession.createDataFrame([(i, j) for i in range(m) for j in range(i, m)], "i int, j int")
        cells = listed.join(F.broadcast(cells), ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "value"))).alias("cells"))
    return packed.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "cells")


def spread(packed: DataFrame, names: Sequence[str], by: Sequence[str], value: Column) -> DataFrame:
    """Mirror the upper triangle and lay it out as one row per matrix cell."""
    by_cols = [ref(b) for b in by]
    labels = F.array(*[F.lit(c) for c in names])
    long = packed.select(*by_cols, F.explode("cells").alias("__u"), "variances")
    long = long.select(*by_cols, F.col("__u.i").alias("__a"), F.col("__u.j").alias("__b"), value.alias("value"))
    both = F.when(F.col("__a") == F.col("__b"), F.array(F.struct(F.col("__a").alias("i"), F.col("__b").alias("j")))).otherwise(
        F.array(F.struct(F.col("__a").alias("i"), F.col("__b").alias("j")), F.struct(F.col("__b").alias("i"), F.col("__a").alias("j")))
    )
    out = long.select(*by_cols, "value", F.explode(both).alias("__s"))
    return out.select(
        *by_cols,
        F.col("__s.i").alias("i"),
        F.col("__s.j").alias("j"),
        labels[F.col("__s.i")].alias("column_i"),
        labels[F.col("__s.j")].alias("column_j"),
        "value",
    )


def with_variances(packed: DataFrame) -> DataFrame:
    """Add the diagonal as an array, in column order."""
    diagonal = F.filter("cells", lambda c: c["i"] == c["j"])
    return packed.withColumn("variances", F.transform(diagonal, lambda c: c["value"]))


def covariance_matrix(df: DataFrame, columns=None, by=None, target: str | None = None) -> DataFrame:
    """Sample covariance with pairwise NULL deletion; undefined cells are 0."""
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by, target)
    packed = with_variances(upper_triangle(df, names, by))
    return spread(packed, names, by, F.col("__u.value"))


def correlation_value() -> Column:
    """cov / sqrt(var var), 0 without variance, 1 on the diagonal, not clamped."""
    var = F.col("variances")
    bottom = F.sqrt(var[F.col("__u.i")] * var[F.col("__u.j")])
    return F.when(F.col("__u.i") == F.col("__u.j"), F.lit(1.0)).otherwise(ratio(F.col("__u.value"), bottom))


def correlation_matrix(df: DataFrame, columns=None, by=None, target: str | None = None) -> DataFrame:
    """Correlation as pairwise covariance over each column's own variance.

    With NULLs this differs from the pairwise Pearson coefficient and may
    exceed 1.
    """
    by = as_list(by)
    require_columns(df, by)
    names = pick(df, columns, by, target)
    packed = with_variances(upper_triangle(df, names, by))
    return spread(packed, names, by, correlation_value())


@dataclass(frozen=True)
class PcaModel:
    """A fitted decomposition; every array is at most m x m."""

    columns: list[str]
    eigenvalues: np.ndarray
    components: np.ndarray
    n_components: int
    means: np.ndarray
    stds: np.ndarray

    @property
    def ratios(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        kept = self.eigenvalues[: self.n_components]
        return kept / total if total > 0 else np.zeros(self.n_components)

    @property
    def loadings(self) -> np.ndarray:
        return self.components[: self.n_components]


def decompose(correlation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending, clamped at 0) and eigenvectors as rows.

    The largest loading of each vector is positive; among equals the first
    column decides.
    """
    values, vectors = np.linalg.eigh(correlation)
    values = np.maximum(values[::-1], 0.0)
    rows = vectors.T[::-1].copy()
    for r in rows:
        size = np.abs(r)
        lead = int(np.argmax(size >= size.max() - 1e-9))
        if r[lead] < 0:
            r *= -1.0
    return values, rows


def fit_pca(df: DataFrame, n_components: int | None = None, columns=None, target: str | None = None) -> PcaModel:
    """Fit on the correlation matrix; means and stds come from the NULL-filled view."""
    names = pick(df, columns, (), target)
    m = len(names)
    if m < 2:
        raise NotEnoughColumns("principal components need at least two numeric columns")
    cells = upper_triangle(df, names).first()["cells"]
    cov = np.zeros((m, m))
    for c in cells:
        cov[c["i"], c["j"]] = cov[c["j"], c["i"]] = c["value"]
    bottom = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    corr = np.divide(cov, bottom, out=np.zeros_like(cov), where=bottom != 0)
    np.fill_diagonal(corr, 1.0)
    values, vectors = decompose(corr)
    stats = df.agg(
        *[F.avg(filled(c)).alias(f"m{k}") for k, c in enumerate(names)],
        *[F.stddev_pop(filled(c)).alias(f"s{k}") for k, c in enumerate(names)],
    ).first()
    flat = np.array([0.0 if v is None else v for v in stats], dtype=float)
    k = m if n_components is None or n_components < 0 else min(int(n_components), m)
    return PcaModel(names, values, vectors, k, flat[:m], flat[m:])


def eigen(df: DataFrame, columns=None, target: str | None = None) -> DataFrame:
    """Eigenvalues and eigenvectors of the correlation matrix, long form."""
    return pca(df, None, columns, target).select("component", "eigenvalue", "column", "loading")


def pca(df: DataFrame, n_components: int | None = None, columns=None, target: str | None = None, model: PcaModel | None = None) -> DataFrame:
    """Variances, ratios and loadings: one row per component and column."""
    fitted = model or fit_pca(df, n_components, columns, target)
    cumulative = np.cumsum(fitted.ratios)
    rows = [
        (k + 1, float(fitted.eigenvalues[k]), float(fitted.ratios[k]), float(cumulative[k]), c, float(fitted.components[k, j]))
        for k in range(fitted.n_components)
        for j, c in enumerate(fitted.columns)
    ]
    schema = "component int, eigenvalue double, ratio double, cumulative double, column string, loading double"
    return df.sparkSession.createDataFrame(rows, schema)


def standardised(model: PcaModel) -> list[Column]:
    """(x - mean) / population std per column; 0 for a constant column."""
    return [
        (filled(c) - F.lit(float(mu))) / F.lit(float(sd)) if sd > 0 else F.lit(0.0)
        for c, mu, sd in zip(model.columns, model.means, model.stds)
    ]


def linear_map(df: DataFrame, keep: Sequence[str], inputs: Sequence[Column], weights: np.ndarray, offsets: np.ndarray, names: Sequence[str]) -> DataFrame:
    """keep + inputs @ weights.T + offsets, in codegen or, when wide, in batches."""
    kept = [ref(c) for c in keep]
    if weights.size <= EXPRESSION_TERMS:
        outputs = []
        for row, shift, name in zip(weights, offsets, names):
            total = F.lit(float(shift))
            for x, w in zip(inputs, row):
                total = total + x * F.lit(float(w))
            outputs.append(total.alias(name))
        return df.select(*kept, *outputs)

    @F.pandas_udf("array<double>")
    def apply(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vectors.to_numpy()) @ weights.T + offsets))

    mapped = df.select(*kept, apply(F.array(*inputs)).alias("__v"))
    return mapped.select(*kept, *[F.col("__v")[k].alias(n) for k, n in enumerate(names)])


def project_onto_pca(df: DataFrame, n_components: int | None = None, keep=None, columns=None, target: str | None = None, model: PcaModel | None = None) -> DataFrame:
    """``keep`` columns plus PC1..PCk of every row."""
    fitted = model or fit_pca(df, n_components, columns, target)
    k = fitted.n_components
    return linear_map(df, as_list(keep), standardised(fitted), fitted.loadings, np.zeros(k), [f"PC{i + 1}" for i in range(k)])


def reconstruct_from_pca(df: DataFrame, n_components: int | None = None, keep=None, columns=None, target: str | None = None, model: PcaModel | None = None, suffix: str = "") -> DataFrame:
    """``keep`` columns plus every feature rebuilt from the first k components."""
    fitted = model or fit_pca(df, n_components, columns, target)
    back = fitted.loadings.T @ fitted.loadings
    weights = back * fitted.stds[:, None]
    return linear_map(df, as_list(keep), standardised(fitted), weights, fitted.means, [c + suffix for c in fitted.columns])
