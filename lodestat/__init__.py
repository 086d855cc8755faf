"""Dataset profiling and nonlinearity diagnostics on Spark DataFrames."""

from lodestat.operators.bds import bds_test, correlation_integral, triple_correlation
from lodestat.operators.categorical import category_frequency, class_distribution, imbalance_ratio, top_k_categories
from lodestat.operators.dependence import (
    autocorrelation,
    delay_mutual_information,
    dependence_comparison,
    detrend,
    memory_profile,
    partial_autocorrelation,
    time_reversal_asymmetry,
)
from lodestat.operators.embedding import delay_embedding, false_nearest_neighbours
from lodestat.operators.features import (
    anova_f_score,
    average_ranks,
    correlation_pairs,
    correlation_with_target,
    detect_type,
    feature_range,
    mutual_information,
    profile_summary,
    range_ratio,
    spearman_correlation_matrix,
    variance_threshold_check,
)
from lodestat.operators.lyapunov import lyapunov_exponent
from lodestat.operators.matrix import (
    correlation_matrix,
    covariance_matrix,
    eigen,
    fit_pca,
    pca,
    project_onto_pca,
    reconstruct_from_pca,
)
from lodestat.operators.nonlinear import (
    combined_score,
    information_ratio,
    interaction_strength,
    nonlinearity_gap,
    polynomial_gain,
    regime_switching,
)
from lodestat.operators.outliers import iqr_outliers, outlier_rate, outlier_rows, zscore_outliers
from lodestat.operators.quality import (
    dataset_missing_rate,
    duplicate_columns,
    duplicate_rows,
    missing_count,
    missing_rate,
    repeated_rows,
)
from lodestat.operators.supervised import design_matrix_and_target, feature_names
from lodestat.operators.surrogate import ar1_fit, surrogate_test
from lodestat.operators.univariate import (
    column_count,
    column_stats,
    column_types,
    entropy,
    extrema,
    kurtosis,
    mean,
    median,
    profile,
    quantiles,
    row_count,
    skewness,
    sparsity,
    std_dev,
    unique_count,
    variance,
)
from lodestat.plans.series import Series, index_series
from lodestat.sources.tables import load_dataset, read_csv, read_stream, read_table, write_result
from lodestat.streaming.profile import covariance_stream, current, profile_stream, write_closed, write_current

__all__ = [name for name in dir() if not name.startswith("_")]
