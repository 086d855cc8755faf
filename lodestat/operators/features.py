"""Feature screening: correlation pairs, information, F score, ranges, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from lodestat.columns import as_list, number, numeric_features, pick, ref, require_columns
from lodestat.errors import ColumnNotFound
from lodestat.functions.scalars import ratio
from lodestat.operators.matrix import correlation_matrix
from lodestat.operators.univariate import column_stats, long_view, profile, unique_count
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.ordering import ranked_values

#: Values of all broadcast rank maps together.
MAP_VALUES = 500_000


def correlation_pairs(df: DataFrame, threshold: float, columns=None) -> DataFrame:
    """Column pairs with abs(r) at or above the threshold, strongest first."""
    cells = correlation_matrix(df, columns)
    strong = cells.where((F.col("i") < F.col("j")) & (F.abs("value") >= F.lit(float(threshold))))
    return strong.orderBy(F.abs("value").desc(), "i", "j").select("column_i", "column_j", F.col("value").alias("correlation"))


def correlation_with_target(df: DataFrame, target: str, columns=None) -> DataFrame:
    """Correlation of every feature with the target."""
    features = pick(df, columns, (target,))
    pick(df, target)
    cells = correlation_matrix(df, [*[c for c in features if c != target], target])
    own = (F.col("column_j") == F.lit(target)) & (F.col("column_i") != F.lit(target))
    return cells.where(own).select(F.col("column_i").alias("column"), F.col("value").alias("correlation"))


def average_ranks(df: DataFrame, columns=None) -> DataFrame:
    """Each numeric column replaced by its average ranks over non-NULL rows.

    The values of all columns are counted, merged on the map side, and the
    distinct ones ranked in one range sort: a map from value to rank for each
    column. Every row stays whole and looks its ranks up, in broadcast maps as
    far as they hold MAP_VALUES values together, the smallest first; beyond,
    in shuffled ones, where adaptive execution splits hot values.
    """
    names = pick(df, columns)
    cells = long_view(df, names, [], number).where(F.col("__value").isNotNull())
    table = ranked_values(cells, ["column"], "__value")
    ranks = stored(table.select("column", "__value", (F.col("__before") + (F.col("__w") + 1) / F.lit(2.0)).alias("rank")))
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}
    rows, held = df.select(*[number(c).alias(f"__v{i}") for i, c in enumerate(names)]), 0
    for i, c in sorted(enumerate(names), key=lambda at: sizes.get(at[1], 0)):
        held += sizes.get(c, 0)
        own = ranks.where(F.col("column") == F.lit(c)).select(F.col("__value").alias(f"__v{i}"), F.col("rank").alias(f"__r{i}"))
        rows = join_on(rows, F.broadcast(own) if held <= MAP_VALUES else own, [f"__v{i}"], "left")
    return rows.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(names)])


def spearman_correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Correlation matrix of average ranks."""
    return correlation_matrix(average_ranks(df, columns))


def information(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mutual information of bin pairs (``__a``, ``__b``) per key, in nats.

    Uses sum(c ln c) over joint and marginal counts, so only counts are
    shuffled and the marginals need no join back.
    """
    key_cols = [ref(k) for k in keys]
    joint = pairs.groupBy(*key_cols, "__a", "__b").agg(F.count(F.lit(1)).alias("__c"))
    none = lambda c: F.when(F.lit(False), F.col(c)).alias(c)
    sides = F.array(F.struct(F.lit(0).alias("side"), "__a", none("__b")), F.struct(F.lit(1).alias("side"), none("__a"), "__b"))
    marginal = joint.select(*key_cols, "__c", F.explode(sides).alias("__s")).groupBy(*key_cols, "__s").agg(F.sum("__c").alias("__c"))
    both = joint.select(*key_cols, F.lit(1.0).alias("__sign"), "__c").unionByName(
        marginal.select(*key_cols, F.lit(-1.0).alias("__sign"), "__c")
    )
    n = F.sum(F.when(F.col("__sign") > 0, F.col("__c")))
    mi = F.sum(F.col("__sign") * F.col("__c") * F.ln("__c")) / n + F.ln(n)
    single = F.count_if(F.col("__sign") > 0) == 1
    return both.groupBy(*key_cols).agg(F.when(single, F.lit(0.0)).otherwise(F.greatest(mi, F.lit(0.0))).alias("mutual_information"))


def equal_bin(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Nearest of ``bins`` equally spaced levels over [low, high]; 0 without range."""
    level = F.floor(F.try_divide(value - low, high - low) * (bins - 1) + F.lit(0.5))
    return F.coalesce(F.least(level.cast("long"), bins.cast("long") - 1), F.lit(0).cast("long"))


def mutual_information(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Mutual information of a feature and a target over complete rows.

    Numeric columns use sqrt(n) equal bins; other columns use their values.
    """
    require_columns(df, [feature, target])
    numeric = set(numeric_features(df))
    pairs = df.select(ref(feature).alias("__x"), ref(target).alias("__y")).where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    sides = [("__x", feature in numeric), ("__y", target in numeric)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, is_number in sides:
        if is_number:
            aggs += [F.min(F.col(name).cast("double")).alias(f"lo{name}"), F.max(F.col(name).cast("double")).alias(f"hi{name}")]
    size = pairs.agg(*aggs).first()
    bins = F.greatest(F.ceil(F.sqrt(F.lit(float(size["n"])))), F.lit(2))

    def binned(name: str, is_number: bool) -> Column:
        if not is_number:
            return F.col(name)
        return equal_bin(F.col(name).cast("double"), F.lit(size[f"lo{name}"]), F.lit(size[f"hi{name}"]), bins)

    placed = pairs.select(binned(*sides[0]).alias("__a"), binned(*sides[1]).alias("__b"))
    return information(placed, []).select(F.lit(feature).alias("feature"), F.lit(target).alias("target"), "mutual_information")


def anova_f_score(df: DataFrame, feature: str, target: str) -> DataFrame:
    """One-way F statistic of a numeric feature across the target's classes."""
    pick(df, feature)
    require_columns(df, [target])
    x = number(feature)
    rows = df.where(x.isNotNull() & ref(target).isNotNull())
    groups = rows.groupBy(ref(target).alias("__g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(F.lit(1))).alias("ssw")
    )
    grand = rows.agg(F.avg(x)).scalar()
    total = groups.withColumn("ssb", F.col("n") * F.pow(F.col("m") - grand, F.lit(2))).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"), F.sum("ssw").alias("ssw"), F.sum("ssb").alias("ssb")
    )
    between = ratio(F.col("ssb"), F.col("classes") - 1, None)
    within = ratio(F.col("ssw"), F.col("rows") - F.col("classes"), None)
    return total.select(F.lit(feature).alias("feature"), F.lit(target).alias("target"), "classes", "rows", ratio(between, within).alias("f_score"))


def variance_threshold_check(df: DataFrame, min_variance: float = 0.01, columns=None) -> DataFrame:
    """Features whose sample variance is below the threshold."""
    return column_stats(df, ["variance"], columns).where(F.col("variance") < F.lit(float(min_variance)))


def feature_range(df: DataFrame, columns=None, by=None) -> DataFrame:
    """Maximum minus minimum per feature."""
    out = column_stats(df, ["min", "max"], columns, by)
    return out.select(*[ref(b) for b in as_list(by)], "column", (F.col("max") - F.col("min")).alias("range"))


def range_ratio(df: DataFrame, columns=None) -> DataFrame:
    """Largest range over the smallest non-zero range."""
    spans = feature_range(df, columns)
    return spans.agg(ratio(F.max("range"), F.min(F.when(F.col("range") != 0, F.col("range")))).alias("range_ratio"))


# Share of a string column's values that must parse for it to count as a type.
PARSE_SHARE = 0.95


def detect_type(df: DataFrame, columns=None) -> DataFrame:
    """Semantic type: numeric, boolean, datetime, categorical or text.

    The Spark type decides first. Strings are tried as numbers, booleans and
    timestamps; what does not parse is categorical when it has at most
    max(20, 5 % of the rows) distinct values.
    """
    names = df.columns if columns is None else as_list(columns)
    require_columns(df, names)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def fixed(name: str) -> str | None:
        kind = kinds[name]
        if isinstance(kind, NumericType):
            return "numeric"
        if isinstance(kind, BooleanType):
            return "boolean"
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            return "datetime"
        return None if isinstance(kind, StringType) else "text"

    structs = []
    for name in names:
        known = fixed(name)
        if known:
            structs.append(F.struct(F.lit(name).alias("column"), F.lit(known).alias("detected_type")))
            continue
        c = ref(name)
        share = lambda kind: F.avg(F.when(c.isNotNull(), c.try_cast(kind).isNotNull().cast("double")))
        few = F.count_distinct(c) <= F.greatest(F.lit(20.0), F.lit(0.05) * F.count(F.lit(1)))
        kind = (
            F.when(share("double") >= PARSE_SHARE, "numeric")
            .when(share("boolean") >= PARSE_SHARE, "boolean")
            .when(share("timestamp") >= PARSE_SHARE, "datetime")
            .when(few, "categorical")
            .otherwise("text")
        )
        structs.append(F.struct(F.lit(name).alias("column"), kind.alias("detected_type")))
    wide = df.agg(F.array(*structs).alias("__a"))
    return wide.select(F.explode("__a").alias("__s")).select("__s.*")


def profile_summary(df: DataFrame, columns=None, by=None, approx: bool = False) -> DataFrame:
    """:func:`profile` with distinct counts: the whole picture in one table."""
    keys = [*as_list(by), "column"]
    names = pick(df, columns, as_list(by))
    return join_on(profile(df, names, by, approx=approx), unique_count(df, names, by), keys)
