"""Metrics of nonlinear structure between columns and in regimes of a series.

Model-based metrics use Spark's own distributed estimators.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, QuantileDiscretizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestat.columns import filled, pick, ref, require_columns
from lodestat.functions.scalars import ratio
from lodestat.operators.features import mutual_information
from lodestat.operators.matrix import correlation_matrix
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.selection import interpolated, interpolation_ranks, select_ranks
from lodestat.plans.series import Series, with_lags

# Share of rows held out when two models are compared.
HOLD_OUT = 0.25
# Rows that a task of a model fit reads, about.
ROWS_PER_TASK = 1_000_000
# Rows that Spark's tree models sample at least to choose split points, and cells between split points that are fitted in
# place of rows: so many are looked at whole.
SPLIT_ROWS = MOST_CELLS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt into more tasks where the scan has too few: files are split by their packed size, but read as rows.

    Beyond ROWS_PER_TASK rows a core; fewer rows stay where the scan put them.
    """
    wanted = -(-df.count() // ROWS_PER_TASK)
    if wanted <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.withColumn("__row", F.monotonically_increasing_id()).repartition(wanted, "__row").drop("__row")


def assembled(df: DataFrame, features: Sequence[str], target: str, extra: Sequence[Column] = ()) -> DataFrame:
    """(features vector, label, extra) from the NULL-filled view."""
    names = [f"__x{i}" for i in range(len(features))]
    flat = df.select(*[filled(c).alias(n) for c, n in zip(features, names)], filled(target).alias("label"), *extra)
    return VectorAssembler(inputCols=names, outputCol="features").transform(spread(flat))


def r_squared(predicted: DataFrame) -> float:
    """1 - SSE / SST of a table with label and prediction."""
    row = predicted.agg(
        F.sum(F.pow(F.col("label") - F.col("prediction"), F.lit(2))), F.var_pop("label") * F.count(F.lit(1))
    ).first()
    return 0.0 if not row[1] else 1.0 - float(row[0]) / float(row[1])


def nonlinearity_gap(df: DataFrame, features: Sequence[str], target: str, key: str | Sequence[str], trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Hold-out R2 of a random forest minus that of linear regression.

    Rows are split by a hash of ``key``, so the split does not depend on how
    the table is partitioned.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, keys)
    pick(df, [*features, target])
    digest = F.md5(F.concat_ws("|", *[F.coalesce(ref(k).cast("string"), F.lit("")) for k in keys]))
    mark = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 < int(HOLD_OUT * 1000)).alias("__held")
    data = stored(assembled(df, features, target, [mark]))
    train, test = data.where(~F.col("__held")), data.where(F.col("__held"))
    linear = r_squared(LinearRegression(solver="normal").fit(train).transform(test))
    forest = r_squared(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(train).transform(test))
    return df.sparkSession.createDataFrame([(linear, forest, forest - linear)], "r2_linear double, r2_nonlinear double, nonlinearity_gap double")


def information_ratio(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information over absolute correlation of two numeric columns."""
    pick(df, [x, y])
    mi = mutual_information(df, x, y).select("mutual_information").scalar()
    r = correlation_matrix(df, [x, y]).where((F.col("i") == 0) & (F.col("j") == 1))
    return r.select(
        F.lit(x).alias("column_x"),
        F.lit(y).alias("column_y"),
        mi.alias("mutual_information"),
        F.col("value").alias("correlation"),
        F.try_divide(mi, F.abs("value")).alias("information_ratio"),
    )


def polynomial_gain(df: DataFrame, features: Sequence[str], target: str, degree: int = 2) -> DataFrame:
    """R2 of a polynomial regression of the standardised features minus linear R2."""
    pick(df, [*features, target])
    stats = df.agg(*[F.avg(filled(c)) for c in features], *[F.stddev_pop(filled(c)) for c in features]).first()
    m = len(features)
    z = [((filled(c) - F.lit(stats[i])) / F.lit(stats[m + i] or 1.0)).alias(f"__z{i}") for i, c in enumerate(features)]
    scaled = df.select(*z, filled(target).alias("__y"))
    data = stored(assembled(scaled, [f"__z{i}" for i in range(m)], "__y"))
    linear = LinearRegression(solver="normal").fit(data).summary.r2
    expanded = PolynomialExpansion(degree=degree, inputCol="features", outputCol="terms").transform(data)
    poly = LinearRegression(solver="normal", featuresCol="terms").fit(expanded).summary.r2
    return df.sparkSession.createDataFrame([(float(linear), float(poly), float(poly - linear))], "r2_linear double, r2_polynomial double, polynomial_gain double")


def sampled(df: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that an RDD of the table samples, as Spark's tree models do."""
    spark = df.sparkSession
    drawn = df._jdf.javaRDD().sample(False, share, spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
    return DataFrame(spark._jsparkSession.createDataFrame(drawn, df._jdf.schema()), spark)


def split_points(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` points between the sampled values of a feature, as Spark's tree models choose them.

    Zeros are not counted but stand for what is missing of the ``expected`` number of samples.
    """
    known, counts = np.unique(values[values != 0.0], return_counts=True)
    counts = counts.astype(float)
    zeros = expected - counts.sum()
    if zeros > np.finfo(float).eps * expected * 100:
        at = np.searchsorted(known, 0.0)
        known, counts = np.insert(known, at, 0.0), np.insert(counts, at, zeros)
    middles = (known[:-1] + known[1:]) / 2
    if len(middles) <= most:
        return middles
    stride, chosen = expected / (most + 1), []
    target, seen = stride, counts[0]
    for index in range(1, len(known)):
        before, seen = seen, seen + counts[index]
        if abs(before - target) < abs(seen - target):
            chosen.append(middles[index - 1])
            target += stride
    return np.array(chosen)


def boosted(data: DataFrame, features: Sequence[str], depth: int, rounds: int, seed: int) -> DataFrame:
    """``data`` (features, label) with the prediction of boosted trees as label.

    Trees see of a row only between which split points its features lie. Where these leave at most MOST_CELLS cells, the
    model is fitted to the cells, weighted by their rows, with their mean labels: the gains and leaves are those of the
    rows, which are read twice and not once for every level of every tree.
    """
    model = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed)
    rows, bins = data.count(), model.getMaxBins()
    wanted = max(bins * bins, SPLIT_ROWS)
    share = wanted / rows if wanted < rows else 1.0
    flat = data.select(*features)
    drawn = np.array((flat if share == 1.0 else sampled(flat, share, seed)).collect(), dtype=float).reshape(-1, len(features))
    points = [split_points(drawn[:, k], share * rows, min(bins, rows) - 1) for k in range(len(features))]
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    if math.prod(len(p) + 1 for p in points) > MOST_CELLS:
        return model.fit(assemble.transform(data)).transform(assemble.transform(data)).select(*features, F.col("prediction").alias("label"))

    @F.pandas_udf("long")
    def cell(*columns: pd.Series) -> pd.Series:
        code = np.zeros(len(columns[0]), np.int64)
        for x, p in zip(columns, points):
            if x.isna().any():
                raise ValueError("NaN in a feature")
            code = code * (len(p) + 1) + np.searchsorted(p, x.to_numpy(), "left")
        return pd.Series(code)

    placed = stored(data.select("*", cell(*features).alias("__cell")))
    found = np.array(placed.groupBy("__cell").agg(F.count(F.lit(1)), F.avg("label")).orderBy("__cell").collect(), dtype=float).reshape(-1, 3)
    places = np.unravel_index(found[:, 0].astype(int), [len(p) + 1 for p in points])
    # Cells are numbered from 1 in each feature, so that none reads as a zero.
    lines = [(int(c), float(w), float(y), *map(float, at)) for (c, w, y), at in zip(found, np.transpose(places) + 1)]
    spark = data.sparkSession
    cells = spark.createDataFrame(lines, ", ".join(["__cell long, __w double, label double", *[f"{f} double" for f in features]])).coalesce(1)
    cells = assemble.transform(cells)
    # A sample of more rows than expected has a split point more: every place between two cells stays one.
    model = model.setWeightCol("__w").setMaxBins(max(bins, *[len(p) + 1 for p in points]))
    predicted = model.fit(cells).transform(cells).select("__cell", "prediction")
    values = F.broadcast(spark.createDataFrame(predicted.collect(), "__cell long, label double"))
    return placed.drop("label").join(values, "__cell").select(*features, "label")


def interaction_strength(df: DataFrame, features: Sequence[str], target: str, bins: int = 20, depth: int = 4, rounds: int = 20, seed: int = 7) -> DataFrame:
    """Share of a boosted-tree model's variance that no additive function explains.

    The model's predictions are regressed on one-hot quantile bins of every
    feature; what is left over comes from interactions.
    """
    pick(df, [*features, target])
    names = [f"__x{i}" for i in range(len(features))]
    data = stored(spread(df.select(*[filled(c).alias(n) for c, n in zip(features, names)], filled(target).alias("label"))))
    scored = boosted(data, names, depth, rounds, seed)
    stages, encoded = [], []
    for i in range(len(features)):
        stages.append(QuantileDiscretizer(numBuckets=bins, inputCol=f"__x{i}", outputCol=f"__b{i}", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"__b{i}", outputCol=f"__h{i}"))
        encoded.append(f"__h{i}")
    stages.append(VectorAssembler(inputCols=encoded, outputCol="features"))
    stages.append(LinearRegression(solver="auto", regParam=1e-9))
    additive = Pipeline(stages=stages).fit(scored).transform(scored)
    left = max(0.0, 1.0 - r_squared(additive))
    return df.sparkSession.createDataFrame([(left,)], "interaction_strength double")


def log_likelihood(n: Column, rss: Column) -> Column:
    """Gaussian log likelihood of n residuals with the given sum of squares."""
    return F.when((n > 0) & (rss > 0), -n / 2 * (F.ln(F.lit(2 * math.pi) * rss / n) + 1))


def residual_squares(s: dict[str, Column]) -> Column:
    """Residual sum of squares of x on y from raw sums."""
    sxx = s["xx"] - s["x"] * s["x"] / s["n"]
    syy = s["yy"] - s["y"] * s["y"] / s["n"]
    sxy = s["xy"] - s["x"] * s["y"] / s["n"]
    return sxx - F.coalesce(F.try_divide(sxy * sxy, syy), F.lit(0.0))


def regime_switching(series: Series, cuts: int = 15, low: float = 0.15, high: float = 0.85, smallest: int = 10) -> DataFrame:
    """Log-likelihood gain of the best two-regime threshold AR(1) over one AR(1).

    Thresholds are quantiles of the previous value. Rows are summed once into
    the intervals between thresholds; every split is then a sum of intervals.
    """
    series.require(2 * smallest + 1)
    keys = series.key_cols()
    shares = [low + (high - low) * k / (cuts - 1) for k in range(cuts)]
    pairs = stored(with_lags(series, [1]).where(F.col("t") >= 1).select(*keys, "x", F.col("lag1").alias("y")))
    centre = pairs.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    found = select_ranks(pairs, ["y"], series.keys, interpolation_ranks(shares))
    grid = found.select(*keys, F.array(*interpolated(shares)).alias("__grid"))
    rows = series.attach(pairs, join_on(centre, grid, series.keys))
    x, y = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    above = F.size(F.filter("__grid", lambda c: c < F.col("y")))
    sums = {"n": F.count(F.lit(1)).cast("double"), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "yy": F.sum(y * y), "xy": F.sum(x * y)}
    parts = rows.withColumn("__k", above).groupBy(*keys, "__k").agg(*[c.alias(f"s_{n}") for n, c in sums.items()], F.first("__grid").alias("__grid"))
    upto = Window.partitionBy(*keys).orderBy("__k")
    whole = Window.partitionBy(*keys)
    for n in sums:
        parts = parts.withColumn(f"l_{n}", F.sum(f"s_{n}").over(upto)).withColumn(f"t_{n}", F.sum(f"s_{n}").over(whole))
    side = lambda tag: {n: F.col(f"{tag}_{n}") for n in sums}
    rest = {n: F.col(f"t_{n}") - F.col(f"l_{n}") for n in sums}
    enough = (F.col("l_n") >= smallest) & (rest["n"] >= smallest)
    split = F.when(enough, log_likelihood(F.col("l_n"), residual_squares(side("l"))) + log_likelihood(rest["n"], residual_squares(rest)))
    single = log_likelihood(F.col("t_n"), residual_squares(side("t")))
    scored = parts.select(*keys, F.get("__grid", F.col("__k")).alias("threshold"), (split - single).alias("delta"))
    best = scored.where(F.col("delta").isNotNull()).groupBy(*keys).agg(F.max(F.struct("delta", "threshold")).alias("__b"))
    return series.present(best, F.col("__b.threshold").alias("threshold"), F.col("__b.delta").alias("delta_log_likelihood"))


SCORE_METRICS = ("nonlinearity_gap", "information_ratio", "polynomial_gain", "lyapunov_exponent", "interaction_strength")


def combined_score(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the metric columns; every weight has to be given."""
    missing = [m for m in SCORE_METRICS if m not in weights]
    if missing:
        raise ValueError(f"weights are required for {missing}")
    require_columns(metrics, SCORE_METRICS)
    total = F.lit(0.0)
    for m in SCORE_METRICS:
        total = total + F.lit(float(weights[m])) * F.coalesce(F.col(m), F.lit(0.0))
    return metrics.withColumn("score", total)
