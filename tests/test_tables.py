import duckdb
import numpy as np
import math

import pytest
from pyspark.sql import functions as F

import lodestat as ls
from lodestat.errors import ColumnNotFound
from lodestat.functions.scalars import normal_cdf


def test_csv_and_sinks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,x,flag,day,name\n1,2.5,true,2024-01-01,a\n2,,false,2024-01-02,\n3,nan,true,,c\n")
    df, summary = ls.load_dataset(spark, str(path), target="x")
    assert tuple(summary.first()) == ("ok", str(path), 3, 1)
    assert np.isnan(df.where("id = 3").first()["x"]) and df.where("id = 2").first()["x"] is None
    with pytest.raises(ColumnNotFound):
        ls.load_dataset(spark, str(path), target="name")
    ls.write_result(ls.mean(df, "id"), str(tmp_path / "out"), "parquet")
    assert ls.read_table(spark, str(tmp_path / "out"), "parquet").first()["mean"] == 2.0


def test_missing_and_duplicates(gaps):
    rate = {r["column"]: r["missing_rate"] for r in ls.missing_rate(gaps).collect()}
    assert rate["b"] == pytest.approx(0.2) and rate["grp"] == 0.0
    assert ls.dataset_missing_rate(gaps).first()[0] == pytest.approx(sum(rate.values()) / len(rate))
    few = gaps.select("c", "grp")
    row = ls.duplicate_rows(few).first()
    assert row["rows"] == 400 and row["distinct_rows"] == few.distinct().count()
    twins = gaps.withColumn("a2", F.col("a")).withColumn("a3", F.when(F.col("id") < 398, F.col("a")))
    assert [tuple(r) for r in ls.duplicate_columns(twins).collect()] == [("a", "a2")]


def test_many_equal_columns(spark, monkeypatch):
    """500 equal columns need 499 comparisons; unequal ones that share a checksum are told apart."""
    wide = spark.range(40).select(*[F.col("id").alias(f"c{i:03d}") for i in range(500)])
    found = ls.duplicate_columns(wide).collect()
    assert len(found) == 500 * 499 // 2 and tuple(found[0]) == ("c000", "c001")
    rows = spark.createDataFrame([(1, 2, 1, 2, None), (2, 1, 2, 1, 5)], "a int, b int, a2 int, b2 int, c int")
    assert sorted(map(tuple, ls.duplicate_columns(rows).collect())) == [("a", "a2"), ("b", "b2")]


@pytest.mark.parametrize("held", [0, 500_000])
def test_ranks_from_maps(spark, monkeypatch, held):
    from lodestat.operators import features

    monkeypatch.setattr(features, "MAP_VALUES", held)
    values = [None, 3.0, 3.0, -0.0, 0.0, float("nan"), 7.5]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, y int")
    got = sorted((r["y"], r["x"]) for r in ls.average_ranks(df).collect())
    assert got == [(1.0, None), (2.0, 3.5), (3.0, 3.5), (4.0, 1.5), (5.0, 1.5), (6.0, 6.0), (7.0, 5.0)]


def test_categories(gaps):
    top = ls.top_k_categories(gaps, "grp", 2).collect()
    assert top[0]["value"] == "hot" and top[0]["count"] == gaps.where("grp = 'hot'").count()
    assert sum(r["share"] for r in ls.category_frequency(gaps, "grp").collect()) == pytest.approx(1.0)
    assert ls.imbalance_ratio(gaps, "c").first()["classes"] == 4


def test_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(500.0,)], "v double")
    assert ls.iqr_outliers(df).first()["outliers"] == 1
    assert ls.zscore_outliers(df).first()["outliers"] == 1
    assert [r["v"] for r in ls.outlier_rows(df, "v").collect()] == [500.0]


def test_spearman_with_ties(gaps):
    got = {(r["column_i"], r["column_j"]): r["value"] for r in ls.spearman_correlation_matrix(gaps, ["a", "c"]).collect()}
    pdf = gaps.select("a", "c").toPandas().rank()
    cov = pdf["a"].cov(pdf["c"]) / np.sqrt(pdf["a"].var() * pdf["c"].var())
    assert got["a", "c"] == pytest.approx(cov)


def test_screening(gaps):
    assert {r["column"] for r in ls.variance_threshold_check(gaps).collect()} == {"k"}
    kinds = {r["column"]: r["detected_type"] for r in ls.detect_type(gaps).collect()}
    assert kinds["grp"] == "categorical" and kinds["a"] == "numeric"
    assert ls.range_ratio(gaps).first()[0] > 1
    f = ls.anova_f_score(gaps, "a", "grp").first()["f_score"]
    rows = [r for r in gaps.collect() if r["a"] is not None]
    groups = [np.array([r["a"] for r in rows if r["grp"] == g]) for g in sorted({r["grp"] for r in rows})]
    every = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(every) - len(groups))
    assert f == pytest.approx(between / within)


def test_interactions_and_gap(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=1500), rng.normal(size=1500)
    df = spark.createDataFrame([(i, float(x), float(y), float(x * y), float(x + y)) for i, (x, y) in enumerate(zip(a, b))], "id int, a double, b double, prod double, total double")
    assert ls.interaction_strength(df, ["a", "b"], "prod", rounds=10).first()[0] > 0.8
    assert ls.interaction_strength(df, ["a", "b"], "total", rounds=10).first()[0] < 0.2
    assert ls.nonlinearity_gap(df, ["a", "b"], "prod", "id").first()["nonlinearity_gap"] > 0.2
    assert ls.polynomial_gain(df, ["a", "b"], "prod").first()["polynomial_gain"] > 0.95


def test_score_needs_weights(spark):
    metrics = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], ", ".join(f"{m} double" for m in ("nonlinearity_gap", "information_ratio", "polynomial_gain", "lyapunov_exponent", "interaction_strength")))
    with pytest.raises(ValueError):
        ls.combined_score(metrics, {"nonlinearity_gap": 1})
    weights = {m: 2.0 for m in metrics.columns}
    assert ls.combined_score(metrics, weights).first()["score"] == 30.0


def test_normal_cdf(spark):
    rows = spark.range(-40, 41).select((F.col("id") / 10).alias("z")).select("z", normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx((1 + math.erf(r["z"] / math.sqrt(2))) / 2, abs=2e-7) for r in rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 8
    assert set(contract.oracle_sql()) <= set(contract.queries())
    con = duckdb.connect()
    con.execute("create view orders as select * from read_parquet('/root/testdata/sf0.001/orders.parquet')")
    got = contract.queries()["quantiles_orders"](spark, "/root/testdata/sf0.001").toPandas().sort_values("column")
    want = con.execute(contract.oracle_sql()["quantiles_orders"]).df().sort_values("column")
    assert got[list(want.columns)].to_numpy().tolist() == want.to_numpy().tolist()


def test_grouping_columns_with_working_names(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (1, 7.0, "b"), (2, 9.0, "b")], "value int, x double, count string")
    assert {r["value"]: r["mean"] for r in ls.mean(df, ["x"], by="value").collect()} == {1: 6.0, 2: 9.0}
    assert {r["value"]: r["median"] for r in ls.quantiles(df, ["x"], by="value").collect()} == {1: 6.0, 2: 9.0}
    assert {r["value"]: r["entropy"] for r in ls.entropy(df, ["x"], by="value").collect()}[2] == 0.0
    top = ls.top_k_categories(df, "count", 1, by="value").collect()
    assert sorted((r["value"], r["value_"], r["count"]) for r in top) == [(1, "a", 1), (2, "b", 1)]
    share = ls.category_frequency(df, "value", by="count").collect()
    assert sorted((r["count"], r["value"], r["count_"], r["share"]) for r in share) == [("a", 1, 1, 1.0), ("b", 1, 1, 0.5), ("b", 2, 1, 0.5)]


def test_model_rows_are_dealt_over_tasks(spark, monkeypatch):
    """However few files the rows come in, no task of a fit reads more than its share."""
    from pyspark.sql import functions as F

    from lodestat.operators import nonlinear

    monkeypatch.setattr(nonlinear, "ROWS_PER_TASK", 100)
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("b")).coalesce(1)
    data = nonlinear.assembled(df, ["a"], "b")
    sizes = [r["count"] for r in data.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 28 and max(sizes) < 200 and sum(sizes) == 3000
    assert sorted(r["label"] for r in data.collect()) == [float(i) for i in range(3000)]


@pytest.mark.parametrize("rows, size", [(3000, 30.0), (13000, 500.0)])
def test_trees_are_fitted_to_cells(spark, monkeypatch, rows, size):
    """Boosted trees see few weighted cells and predict for every row what they predict when fitted to the rows."""
    from lodestat.operators import nonlinear

    rng = np.random.default_rng(8)
    x, z = np.round(rng.exponential(size, rows), 1), rng.integers(-4, 5, rows).astype(float)
    x[rng.random(rows) < 0.1] = 0.0
    y = np.where(x > size, z * x, -z) + np.round(rng.normal(size=rows), 2)
    data = spark.createDataFrame(list(zip(x.tolist(), z.tolist(), y.tolist())), "__x0 double, __x1 double, label double").repartition(3).localCheckpoint()
    seen, fit = [], nonlinear.GBTRegressor.fit
    monkeypatch.setattr(nonlinear.GBTRegressor, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    values = lambda: {(r[0], r[1]): r[2] for r in nonlinear.boosted(data, ["__x0", "__x1"], 4, 5, 7).collect()}
    few = values()
    monkeypatch.setattr(nonlinear, "MOST_CELLS", 0)
    assert few == pytest.approx(values()) and len(few) == len(set(zip(x, z)))
    assert seen[0] <= 33 * 9 and seen[1] == rows


def test_no_tree_of_nan(spark):
    df = spark.createDataFrame([(float(i % 7), math.nan if i == 5 else 1.0, float(i)) for i in range(50)], "a double, b double, y double")
    with pytest.raises(Exception, match="NaN"):
        ls.interaction_strength(df, ["a", "b"], "y").first()
