"""One query per operator over the given tables: ``name -> (spark, dir) -> DataFrame``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lodestat as ls
from lodestat.operators.nonlinear import SCORE_METRICS
from lodestat.plans.checkpoints import ensure_checkpoint_dir
from lodestat.plans.series import Series
from registry.rounding import rounded

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRICE_QTY = ["l_extendedprice", "l_quantity"]
SIG_PROFILE = ("missing_rate", "mean", "variance", "std_dev", "min", "q25", "median", "q75", "max", "sparsity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with NULLs in two columns, to exercise the NULL rules."""
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        "l_returnflag",
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")).alias("discount"),
        "l_tax",
    )


def by_type(spark: SparkSession, sf_dir: str) -> Series:
    return ls.index_series(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], "event_type")


def whole(spark: SparkSession, sf_dir: str) -> Series:
    return ls.index_series(table(spark, sf_dir, "events"), "value", ["ts", "event_id"])


def by_user(spark: SparkSession, sf_dir: str) -> Series:
    return ls.index_series(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], "user_id")


def profile_lineitem(spark, d):
    return rounded(ls.profile(table(spark, d, "lineitem")), SIG_PROFILE, skewness=6, kurtosis=6, entropy=8)


def profile_orders_by_status(spark, d):
    out = ls.profile(table(spark, d, "orders"), ["o_custkey", "o_totalprice"], by="o_orderstatus")
    return rounded(out, SIG_PROFILE, skewness=6, kurtosis=6, entropy=8)


def profile_with_nulls(spark, d):
    return rounded(ls.profile(gappy(spark, d)), SIG_PROFILE, skewness=6, kurtosis=6, entropy=8)


def profile_range_sort_lineitem(spark, d):
    return rounded(ls.profile(table(spark, d, "lineitem"), bracket_rows=64), SIG_PROFILE, skewness=6, kurtosis=6, entropy=8)


def profile_summary_customer(spark, d):
    return rounded(ls.profile_summary(table(spark, d, "customer")), SIG_PROFILE, skewness=6, kurtosis=6, entropy=8)


def row_count_by_flag(spark, d):
    return ls.row_count(table(spark, d, "lineitem"), by=["l_returnflag", "l_linestatus"])


def column_types_lineitem(spark, d):
    df = table(spark, d, "lineitem")
    counts = ls.column_stats(df, ["count"], LINEITEM)
    return ls.column_types(df).join(counts, "column").select("column", "type", "spark_type", "count")


def column_count_lineitem(spark, d):
    df = table(spark, d, "lineitem")
    return ls.row_count(df).select("rows", ls.column_count(df).scalar().alias("columns"))


def mean_by_flag(spark, d):
    return rounded(ls.mean(table(spark, d, "lineitem"), PRICE_QTY, by="l_returnflag"), ["mean"])


def variance_customer(spark, d):
    return rounded(ls.variance(table(spark, d, "customer"), by="c_mktsegment"), ["variance"])


def std_dev_part(spark, d):
    return rounded(ls.std_dev(table(spark, d, "part")), ["std_dev"])


def extrema_events(spark, d):
    return rounded(ls.extrema(table(spark, d, "events"), by="event_type"), ["min", "max"])


def median_events(spark, d):
    return rounded(ls.median(table(spark, d, "events"), "value", by="event_type"), ["median"])


def quantiles_orders(spark, d):
    return rounded(ls.quantiles(table(spark, d, "orders")), ["min", "q25", "median", "q75", "max"])


def quantiles_range_sort_by_flag(spark, d):
    out = ls.quantiles(gappy(spark, d), ["qty", "price", "discount"], by="l_returnflag", bracket_rows=16)
    return rounded(out, ["min", "q25", "median", "q75", "max"])


def skewness_events(spark, d):
    return rounded(ls.skewness(table(spark, d, "events"), "value", by="event_type"), skewness=6)


def kurtosis_events(spark, d):
    return rounded(ls.kurtosis(table(spark, d, "events"), "value", by="event_type"), kurtosis=6)


def sparsity_with_nulls(spark, d):
    return rounded(ls.sparsity(gappy(spark, d)), ["sparsity"])


def entropy_lineitem(spark, d):
    return rounded(ls.entropy(table(spark, d, "lineitem")), entropy=8)


def entropy_with_nulls_by_flag(spark, d):
    return rounded(ls.entropy(gappy(spark, d), ["qty", "price", "discount"], by="l_returnflag"), entropy=8)


def entropy_range_sort_events(spark, d):
    return rounded(ls.entropy(table(spark, d, "events"), "value", by="event_type", bracket_rows=16), entropy=8)


def unique_count_lineitem(spark, d):
    return ls.unique_count(table(spark, d, "lineitem"))


def unique_count_by_flag(spark, d):
    return ls.unique_count(table(spark, d, "lineitem"), ["l_partkey", "l_linestatus", "l_discount"], by="l_returnflag")


def covariance_lineitem(spark, d):
    return rounded(ls.covariance_matrix(table(spark, d, "lineitem")), ["value"])


def covariance_with_nulls(spark, d):
    return rounded(ls.covariance_matrix(gappy(spark, d), by="l_returnflag"), ["value"])


def covariance_wide_embeddings(spark, d):
    df = table(spark, d, "embeddings")
    wide = df.select(*[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(64)])
    return rounded(ls.covariance_matrix(wide).select("i", "j", "value"), value=9)


def covariance_embeddings_by_label(spark, d):
    df = table(spark, d, "embeddings")
    wide = df.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(64)])
    return rounded(ls.covariance_matrix(wide, by="label").select("label", "i", "j", "value"), value=9)


def correlation_lineitem(spark, d):
    return rounded(ls.correlation_matrix(table(spark, d, "lineitem")), value=8)


def correlation_with_nulls(spark, d):
    return rounded(ls.correlation_matrix(gappy(spark, d)), value=8)


def correlation_pairs_lineitem(spark, d):
    return rounded(ls.correlation_pairs(table(spark, d, "lineitem"), 0.004), correlation=8)


def correlation_with_price(spark, d):
    return rounded(ls.correlation_with_target(table(spark, d, "lineitem"), "l_extendedprice"), correlation=8)


def spearman_lineitem(spark, d):
    return rounded(ls.spearman_correlation_matrix(gappy(spark, d)), value=8)


def eigen_price_qty(spark, d):
    return rounded(ls.eigen(table(spark, d, "lineitem"), PRICE_QTY), eigenvalue=8, loading=8)


def pca_price_qty(spark, d):
    return rounded(ls.pca(table(spark, d, "lineitem"), None, PRICE_QTY), eigenvalue=8, ratio=8, cumulative=8, loading=8)


def pca_spectrum_lineitem(spark, d):
    one = ls.pca(table(spark, d, "lineitem")).groupBy("component").agg(F.max("eigenvalue").alias("v"), F.sum(F.col("loading") ** 2).alias("l"))
    out = one.agg(F.count(F.lit(1)).alias("components"), F.sum("v").alias("trace"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.sum("l").alias("norms"))
    return rounded(out, trace=8, energy=8, norms=8)


def project_price_qty(spark, d):
    df = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "k", "l_linenumber": "line"})
    return rounded(ls.project_onto_pca(df, 2, ["k", "line"], PRICE_QTY), PC1=7, PC2=7)


def project_with_nulls(spark, d):
    out = ls.project_onto_pca(gappy(spark, d), 1, ["l_returnflag"], ["price", "l_tax"]).groupBy("l_returnflag")
    return rounded(out.agg(F.sum(F.abs("PC1")).alias("size"), F.count(F.lit(1)).alias("rows")), ["size"])


def reconstruct_one_component(spark, d):
    df = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "k", "l_linenumber": "line"})
    return rounded(ls.reconstruct_from_pca(df, 1, ["k", "line"], PRICE_QTY), l_extendedprice=4, l_quantity=6)


def reconstruct_full_lineitem(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = ls.reconstruct_from_pca(table(spark, d, "lineitem"), 4, ["l_orderkey", "l_linenumber"], cols)
    return rounded(out, l_quantity=5, l_extendedprice=5, l_discount=5, l_tax=5)


def split_frame(df: DataFrame, width: int) -> DataFrame:
    keep = [c for c in df.columns if c not in ("features", "label")]
    return df.select(*keep, *[F.col("features")[i].alias(f"x{i}") for i in range(width)], "label")


def design_matrix_regression(spark, d):
    df = table(spark, d, "lineitem").drop("l_partkey", "l_suppkey")
    return split_frame(ls.design_matrix_and_target(df, "l_extendedprice", "regression", ["l_orderkey"]), 4)


def design_matrix_binary(spark, d):
    return split_frame(ls.design_matrix_and_target(table(spark, d, "labels"), "quality", "binary_classification"), 2)


def design_matrix_multi(spark, d):
    df = gappy(spark, d).select("qty", "price", "l_tax")
    return split_frame(ls.design_matrix_and_target(df, "qty", "multi_category"), 2)


def detrend_events(spark, d):
    return rounded(ls.detrend(by_type(spark, d)), x=6)


def time_reversal_events(spark, d):
    return rounded(ls.time_reversal_asymmetry(by_type(spark, d)), asymmetry=3)


def autocorrelation_events(spark, d):
    return rounded(ls.autocorrelation(by_type(spark, d), 10), autocorrelation=8)


def autocorrelation_by_user(spark, d):
    return rounded(ls.autocorrelation(by_user(spark, d), 3), autocorrelation=8)


def partial_autocorrelation_events(spark, d):
    return rounded(ls.partial_autocorrelation(by_type(spark, d), 2), partial_autocorrelation=8)


def delay_information_events(spark, d):
    return rounded(ls.delay_mutual_information(whole(spark, d), 8), mutual_information=8)


def dependence_events(spark, d):
    return rounded(ls.dependence_comparison(by_type(spark, d), 10), autocorrelation=8, mutual_information=8)


def memory_events(spark, d):
    out = ls.memory_profile(by_type(spark, d), 10)
    lags = range(1, 11)
    flat = out.select(
        "event_type",
        *[F.col("partial_autocorrelations")[k - 1].alias(f"pacf{k}") for k in lags],
        *[F.col("delay_mutual_informations")[k - 1].alias(f"mi{k}") for k in lags],
        "active_information_storage",
        "memory_length",
    )
    return rounded(flat, active_information_storage=8, **{f"{c}{k}": 8 for c in ("pacf", "mi") for k in lags})


def correlation_integral_events(spark, d):
    return rounded(ls.correlation_integral(by_type(spark, d), 3, 25.0), correlation_integral=10)


def triple_correlation_events(spark, d):
    return rounded(ls.triple_correlation(by_type(spark, d), 25.0), triple_correlation=10)


def bds_events(spark, d):
    out = ls.bds_test(by_type(spark, d), 3, 40.0)
    return rounded(out, c1=10, cm=10, k=10, statistic=7, p_value=7)


def bds_rank_boxes_events(spark, d):
    out = ls.bds_test(by_type(spark, d), 3, 40.0, method="boxes")
    return rounded(out, c1=10, cm=10, k=10, statistic=7, p_value=7)


def lyapunov_events(spark, d):
    return rounded(ls.lyapunov_exponent(by_type(spark, d), 3, 1), lyapunov_exponent=9)


def false_neighbours_events(spark, d):
    return rounded(ls.false_nearest_neighbours(by_type(spark, d), 3, tau=2), false_share=9)


def delay_embedding_events(spark, d):
    return ls.delay_embedding(by_type(spark, d), 10)


def ar1_fit_events(spark, d):
    return rounded(ls.ar1_fit(by_type(spark, d)), mean=6, phi=8, asymmetry=3)


def delay_information_by_user(spark, d):
    return rounded(ls.delay_mutual_information(by_user(spark, d), 3), mutual_information=8)


def lyapunov_grid_events(spark, d):
    return rounded(ls.lyapunov_exponent(by_type(spark, d), 3, 1, method="tree"), lyapunov_exponent=9)


def surrogate_events(spark, d):
    out = ls.surrogate_test(by_type(spark, d))
    return rounded(out, statistic_real=3, surrogate_mean=3, surrogate_std=3, z_score=5)


def streamed(spark: SparkSession, d: str, profile) -> DataFrame:
    """Stream all of events through ``profile`` and read the final state of every window."""
    events = table(spark, d, "events")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    made = profile(ls.read_stream(spark, f"{d}/event[s].parquet", events.schema))
    ls.write_current(made, f"{folder}/out", f"{folder}/state").awaitTermination()
    out = ls.current(spark, f"{folder}/out", made)
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start", "window_end")


def profile_stream_events(spark, d):
    out = streamed(spark, d, lambda s: ls.profile_stream(s, "ts", "1 day", "2 hours", ["value", "user_id"], "event_type"))
    return rounded(out, ["mean", "variance", "sparsity"], skewness=6)


def covariance_stream_events(spark, d):
    out = streamed(spark, d, lambda s: ls.covariance_stream(s, "ts", "1 day", "2 hours", ["value", "user_id"]))
    return rounded(out.drop("column_i", "column_j"), value=6)


def missing_documents(spark, d):
    df = table(spark, d, "documents")
    odd = df.select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), "n_chars")
    counts = ls.missing_count(odd)
    return rounded(counts.join(ls.missing_rate(odd), "column"), ["missing_rate"])


def dataset_missing_rate_lineitem(spark, d):
    return rounded(ls.dataset_missing_rate(gappy(spark, d)), ["missing_rate"])


def duplicate_rows_lineitem(spark, d):
    return ls.duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


def repeated_documents(spark, d):
    return ls.repeated_rows(table(spark, d, "documents").select("text", "lang")).select(F.md5("text").alias("digest"), "lang", "copies")


def duplicate_columns_lineitem(spark, d):
    df = table(spark, d, "lineitem").withColumn("qty_again", F.col("l_quantity")).withColumn("flag_again", F.col("l_returnflag"))
    return ls.duplicate_columns(df)


def top_part_types(spark, d):
    return ls.top_k_categories(table(spark, d, "part"), "p_type", 10)


def top_types_per_brand(spark, d):
    return ls.top_k_categories(table(spark, d, "part"), "p_type", 3, by="p_brand")


def category_frequency_segments(spark, d):
    return rounded(ls.category_frequency(table(spark, d, "customer"), "c_mktsegment"), ["share"])


def iqr_outliers_lineitem(spark, d):
    return rounded(ls.iqr_outliers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), ["lower", "upper", "outlier_rate"])


def iqr_outliers_events(spark, d):
    return rounded(ls.iqr_outliers(table(spark, d, "events"), "value", by="event_type"), ["lower", "upper", "outlier_rate"])


def outlier_rate_events(spark, d):
    return rounded(ls.outlier_rate(table(spark, d, "events"), "value"), ["outlier_rate"])


def outlier_rows_events(spark, d):
    return ls.outlier_rows(table(spark, d, "events"), "value", by="event_type").select("event_id", "event_type", "value")


def zscore_outliers_events(spark, d):
    return rounded(ls.zscore_outliers(table(spark, d, "events"), "value", by="event_type"), ["lower", "upper", "outlier_rate"])


def low_variance_lineitem(spark, d):
    return rounded(ls.variance_threshold_check(table(spark, d, "lineitem"), 0.01), ["variance"])


def mutual_information_price(spark, d):
    return rounded(ls.mutual_information(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), mutual_information=8)


def mutual_information_flag(spark, d):
    return rounded(ls.mutual_information(gappy(spark, d), "price", "l_returnflag"), mutual_information=8)


def anova_priority(spark, d):
    return rounded(ls.anova_f_score(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"), f_score=7)


def detect_type_orders(spark, d):
    df = table(spark, d, "orders").withColumn("as_text", F.col("o_totalprice").cast("string")).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    docs = table(spark, d, "documents").select("text", "lang", "source")
    flags = table(spark, d, "labels").select((F.col("quality") == 1).cast("string").alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return ls.detect_type(df).unionByName(ls.detect_type(docs)).unionByName(ls.detect_type(flags))


def feature_range_lineitem(spark, d):
    return rounded(ls.feature_range(table(spark, d, "lineitem")), ["range"])


def range_ratio_lineitem(spark, d):
    return rounded(ls.range_ratio(table(spark, d, "lineitem")), ["range_ratio"])


def class_distribution_quality(spark, d):
    return rounded(ls.class_distribution(table(spark, d, "labels"), "quality"), ["share"])


def imbalance_toxic(spark, d):
    return rounded(ls.imbalance_ratio(table(spark, d, "labels"), "toxic"), ["imbalance_ratio"])


def information_ratio_orders(spark, d):
    joined = table(spark, d, "lineitem")
    return rounded(ls.information_ratio(joined, "l_quantity", "l_extendedprice"), ["information_ratio"], mutual_information=8, correlation=8)


def polynomial_gain_part(spark, d):
    return rounded(ls.polynomial_gain(table(spark, d, "part"), ["p_partkey"], "p_retailprice", 2), r2_linear=6, r2_polynomial=6, polynomial_gain=6)


def nonlinearity_gap_part(spark, d):
    return ls.nonlinearity_gap(table(spark, d, "part"), ["p_partkey", "p_size"], "p_retailprice", "p_partkey")


def interaction_strength_lineitem(spark, d):
    df = table(spark, d, "lineitem").withColumn("charge", F.col("l_quantity") * F.col("l_tax"))
    return ls.interaction_strength(df, ["l_quantity", "l_tax"], "charge")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with indicators that a regression tree learns exactly."""
    late, back = (F.col("l_linenumber") > 3).cast("double"), (F.col("l_returnflag") == "R").cast("double")
    return table(spark, d, "lineitem").withColumns({"late": late, "back": back, "both": late * back})


def nonlinearity_gap_lineitem(spark, d):
    out = ls.nonlinearity_gap(steps(spark, d), ["l_linenumber"], "late", ["l_orderkey", "l_linenumber"])
    return rounded(out, r2_linear=6, r2_nonlinear=6, nonlinearity_gap=6)


def interaction_strength_steps(spark, d):
    return rounded(ls.interaction_strength(steps(spark, d), ["late", "back"], "both"), interaction_strength=6)


def combined_score_steps(spark, d):
    chaos = ls.lyapunov_exponent(by_type(spark, d), 3, 1).agg(F.avg("lyapunov_exponent").alias("lyapunov_exponent"))
    parts = [nonlinearity_gap_lineitem(spark, d), information_ratio_orders(spark, d), polynomial_gain_part(spark, d), chaos, interaction_strength_steps(spark, d)]
    metrics = spark.range(1).select(*[p.select(m).scalar().alias(m) for p, m in zip(parts, SCORE_METRICS)])
    out = ls.combined_score(metrics, {m: 0.1 if m == "information_ratio" else 1 for m in SCORE_METRICS})
    return rounded(out, information_ratio=3, score=3, **{m: 6 for m in SCORE_METRICS if m != "information_ratio"})


def regime_switching_events(spark, d):
    return rounded(ls.regime_switching(by_type(spark, d)), threshold=6, delta_log_likelihood=5)


def combined_score_lineitem(spark, d):
    df = table(spark, d, "lineitem")
    gap = ls.nonlinearity_gap(df, ["l_quantity", "l_discount"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
    ratio = ls.information_ratio(df, "l_quantity", "l_extendedprice").select("information_ratio")
    gain = ls.polynomial_gain(df, ["l_quantity", "l_discount"], "l_extendedprice").select("polynomial_gain")
    chaos = ls.lyapunov_exponent(by_type(spark, d), 2, 1).agg(F.avg("lyapunov_exponent").alias("lyapunov_exponent"))
    tied = ls.interaction_strength(df, ["l_quantity", "l_discount"], "l_extendedprice")
    scalar = lambda t: t.scalar()
    metrics = gap.select("nonlinearity_gap", scalar(ratio).alias("information_ratio"), scalar(gain).alias("polynomial_gain"), scalar(chaos).alias("lyapunov_exponent"), scalar(tied).alias("interaction_strength"))
    return ls.combined_score(metrics, {"nonlinearity_gap": 1, "information_ratio": 0.1, "polynomial_gain": 1, "lyapunov_exponent": 1, "interaction_strength": 1})


HELPERS = {"table", "gappy", "steps", "by_type", "whole", "by_user", "split_frame", "rounded", "streamed", "ensure_checkpoint_dir"}


def all_queries():
    own = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__}
    return {k: v for k, v in own.items() if k not in HELPERS and k != "all_queries"}
