import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestat as ls
from lodestat.errors import ColumnNotFound, InvalidPredictionTask, NotEnoughColumns


def cells(df):
    return {(r["column_i"], r["column_j"]): r["value"] for r in df.collect()}


def test_correlation_of_sample(sample):
    r = cells(ls.correlation_matrix(sample))
    assert r["id", "age"] == pytest.approx(0.17483551, abs=1e-8)
    assert r["age", "income"] == r["income", "age"] == pytest.approx(0.92222858, abs=1e-8)
    assert all(r[c, c] == 1.0 for c in sample.columns)


def test_pairwise_nulls_and_constant_column(gaps):
    df = gaps.select("a", "b", "c", "k")
    rows = np.array([[np.nan if v is None else v for v in r] for r in df.collect()], dtype=float)
    cov = cells(ls.covariance_matrix(df))
    ok = ~np.isnan(rows[:, 0]) & ~np.isnan(rows[:, 1])
    ab = np.cov(rows[ok, 0], rows[ok, 1])[0, 1]
    assert cov["a", "b"] == pytest.approx(ab)
    va, vb = np.nanvar(rows[:, 0], ddof=1), np.nanvar(rows[:, 1], ddof=1)
    r = cells(ls.correlation_matrix(df))
    assert r["a", "b"] == pytest.approx(ab / np.sqrt(va * vb))
    assert r["a", "k"] == 0.0 and r["k", "k"] == 1.0


@pytest.mark.parametrize("width", [2, 4, 5, 9])
def test_one_rule_for_every_width(spark, width):
    """NULL is deleted pairwise, NaN and infinities make a cell NaN, in any group and width."""
    rng = np.random.default_rng(width)
    rows = []
    for i in range(300):
        x = [float(v) if rng.random() > 0.2 else None for v in rng.normal(1e6, 3, width)]
        if i % 40 == 0:
            x[i // 40 % width] = [np.nan, np.inf, None, 7.0][i // 40 % 4]
        rows.append(([None, "a", "b"][i % 3], i % 2, *x))
    columns = [f"x{j}" for j in range(width)]
    df = spark.createDataFrame(rows, "g string, h int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = {(r["g"], r["h"], r["i"], r["j"]): r["value"] for r in ls.covariance_matrix(df, columns, by=["g", "h"]).collect()}
    assert len(got) == 6 * width * width
    alone = cells(ls.covariance_matrix(df, columns))
    aggregates = df.agg(*[F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"{a}{b}") for a in columns for b in columns]).first()
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            assert alone[a, b] == pytest.approx(aggregates[f"{a}{b}"], nan_ok=True, rel=1e-6, abs=1e-9)
            for g in (None, "a", "b"):
                for h in (0, 1):
                    pairs = np.array([(r[2 + i], r[2 + j]) for r in rows if r[:2] == (g, h) and r[2 + i] is not None and r[2 + j] is not None])
                    with np.errstate(invalid="ignore"):
                        want = np.nan if not np.isfinite(pairs).all() else np.cov(pairs[:, 0], pairs[:, 1])[0, 1]
                    assert got[g, h, i, j] == pytest.approx(want, nan_ok=True, rel=1e-6, abs=1e-9)


def test_covariance_without_rows(spark):
    none = spark.createDataFrame([], "a double, b double, g string")
    assert cells(ls.covariance_matrix(none)) == {(x, y): 0.0 for x in "ab" for y in "ab"}
    assert ls.covariance_matrix(none, by="g").count() == 0


def test_eigenvalues_and_full_reconstruction(sample):
    out = ls.pca(sample).collect()
    values = sorted({r["eigenvalue"] for r in out}, reverse=True)
    assert values == pytest.approx([1.9942069, 1.19255805, 0.75849925, 0.0547358], abs=1e-7)
    assert max(r["cumulative"] for r in out) == pytest.approx(1.0)
    back = np.array(ls.reconstruct_from_pca(sample).collect())
    assert np.allclose(back, np.array(sample.collect()))


def test_projection_matches_numpy(gaps):
    names = ["a", "b", "c", "k"]
    model = ls.fit_pca(gaps, 2, names)
    got = {r["id"]: (r["PC1"], r["PC2"]) for r in ls.project_onto_pca(gaps, keep="id", model=model).collect()}
    for row in gaps.collect():
        x = np.array([0.0 if row[c] is None else row[c] for c in names], dtype=float)
        z = np.where(model.stds > 0, (x - model.means) / np.where(model.stds > 0, model.stds, 1), 0.0)
        assert got[row["id"]] == pytest.approx(tuple(model.loadings @ z))
    assert ls.project_onto_pca(gaps, 0, "id", names).columns == ["id"]


def test_wide_projection_in_batches(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 50))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"c{i} double" for i in range(50)))
    back = np.array(ls.reconstruct_from_pca(df).collect())
    assert np.allclose(np.sort(back, axis=0), np.sort(data, axis=0))


def test_too_few_columns(sample):
    with pytest.raises(NotEnoughColumns):
        ls.pca(sample.select("age"))


def test_split(sample, gaps):
    out = ls.design_matrix_and_target(sample, "score", "regression")
    assert ls.feature_names(sample, "score") == ["id", "age", "income"]
    assert out.orderBy("label").first()["label"] == 0.0 and len(out.first()["features"]) == 3
    with_null = ls.design_matrix_and_target(gaps.select("a", "c"), "c", "multi_category")
    assert with_null.where("label = 0").count() == gaps.where("c is null or c = 0").count()


def test_split_label_rules(spark, gaps):
    two = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 0.0)], "f double, y double")
    assert ls.design_matrix_and_target(two, "y", "binary_classification").count() == 3
    with pytest.raises(InvalidPredictionTask):
        ls.design_matrix_and_target(two, "y", "multi_category")
    with pytest.raises(InvalidPredictionTask):
        ls.design_matrix_and_target(gaps.select("a", "c"), "c", "binary_classification")
    with pytest.raises(ColumnNotFound):
        ls.design_matrix_and_target(two, "nope", "regression")
    with pytest.raises(NotEnoughColumns):
        ls.design_matrix_and_target(two, "y", "regression", target="y")
