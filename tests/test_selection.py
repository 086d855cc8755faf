import math
import random

import pytest
from pyspark.sql import functions as F

import lodestat as ls
from lodestat.operators.univariate import PROFILE_STATISTICS, STATISTICS, column_rows
from lodestat.plans.selection import Rank, _spans, _values, bucket, select_ranks

SPECIAL = [None, float("nan"), math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, -1.0]


def key(x):
    return (math.isnan(x), x)


def drawn(seed, n):
    draw = random.Random(seed)
    kinds = [lambda: draw.choice(SPECIAL), lambda: draw.gauss(0, 1), lambda: float(draw.randrange(5)), lambda: 1.7e9 + draw.random(), lambda: draw.lognormvariate(0, 30)]
    return [draw.choice(kinds)() for _ in range(n)]


def test_bucket_never_falls(spark):
    values = sorted((x for x in drawn(1, 3000) if x is not None), key=key)
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("b", bucket(F.col("v"))).orderBy("i").collect()
    numbers = [r["b"] for r in rows]
    assert numbers == sorted(numbers) and all(b is not None for b in numbers)


@pytest.mark.parametrize("bracket_rows", [1, 40, 65_536])
def test_every_rank_against_a_sort(spark, bracket_rows):
    groups = {g: drawn(k, n) for k, (g, n) in enumerate({None: 120, "a": 400, "b": 1, "gone": 3, "hot": 1500}.items())}
    groups["gone"] = [None] * 3
    rows = [(g, v, -1.0 if v is None else v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    of = lambda p: lambda n: F.floor((n - 1) * F.lit(float(p)))
    ranks = [Rank(f"p{i}", of(p)) for i, p in enumerate(shares)] + [Rank(f"f{i}", of(p), True) for i, p in enumerate(shares)]
    got = {(r["g"], r["column"]): r for r in select_ranks(df, ["x", "y"], ["g"], ranks, bracket_rows=bracket_rows).collect()}
    for g in groups:
        for c, at in (("x", 1), ("y", 2)):
            mine = [r[at] for r in rows if r[0] == g]
            present = sorted((v for v in mine if v is not None), key=key)
            full = sorted((0.0 if v is None else v for v in mine), key=key)
            for tag, have in (("p", present), ("f", full)):
                for i, p in enumerate(shares):
                    found = got[g, c][f"{tag}{i}"]
                    want = have[math.floor((len(have) - 1) * p)] if have else None
                    assert found == want or (math.isnan(found) and math.isnan(want)), (g, c, tag, p)
            assert (got[g, c]["__rows"], got[g, c]["__present"]) == (len(mine), len(present))


def test_code_per_value_does_not_grow_with_the_spans(spark):
    df = spark.createDataFrame([(g, float(x)) for g in ("a", None) for x in range(100)] + [("a", None), ("a", math.nan)], "g string, x double")
    made = lambda n: [("a", "x", 0.0, 0.0), *((g, "x", 4.0 * k + 1, (4.0 * k + 1) * 1.001) for g in ("a", None) for k in range(n))]
    aims = {n: spark.createDataFrame(made(n), "g string, column string, lo double, hi double") for n in (2, 20)}
    found = {n: _values(df, ["x"], ["g"], _spans(a, ["g", "column"])) for n, a in aims.items()}
    for n, cells in found.items():
        want = [(g, float(4 * k + 1)) for g in ("a", None) for k in range(n)]
        assert sorted(((r["g"], r["__value"]) for r in cells.collect()), key=str) == sorted(want, key=str)
    stored = {n: spark.createDataFrame((t := _spans(a, ["g", "column"])).collect(), t.schema) for n, a in aims.items()}
    plans = {n: _values(df, ["x"], ["g"], t)._jdf.queryExecution().optimizedPlan().toString().split("\n") for n, t in stored.items()}
    size = {n: sum(len(x) for x in plan if "Filter" in x or "Generate" in x) for n, plan in plans.items()}
    assert size[2] == pytest.approx(size[20], abs=60)


def test_merged_moments_equal_plain_aggregates(spark, gaps):
    draw = random.Random(3)
    far = spark.createDataFrame([(1.7e9 + draw.gauss(0, 5), draw.lognormvariate(0, 3), None) for _ in range(500)], "t double, w double, z double")
    for df in (gaps, far, far.limit(2), far.limit(1)):
        got = {r["column"]: r for r in ls.profile(df).collect()}
        for r in column_rows(df, list(got), {s: STATISTICS[s] for s in PROFILE_STATISTICS}).collect():
            for s in PROFILE_STATISTICS:
                assert got[r["column"]][s] == pytest.approx(r[s], rel=1e-7, abs=1e-9), (r["column"], s)


def test_approximate_profile_is_near(gaps):
    exact = {r["column"]: r for r in ls.profile(gaps).collect()}
    for r in ls.profile(gaps, approx=True).collect():
        for q in ("q25", "median", "q75"):
            assert r[q] == pytest.approx(exact[r["column"]][q], rel=4e-3, abs=1e-9)
    near = {r["column"]: r["median"] for r in ls.profile_summary(gaps, approx=True).collect()}
    assert near["a"] == pytest.approx(exact["a"]["median"], rel=4e-3)
    assert ls.iqr_outliers(gaps, approx=True).count() == len(exact)


def test_no_rows(spark):
    row = select_ranks(spark.createDataFrame([], "x double"), ["x"], [], [Rank("m", lambda n: n / 2)], moments=True).first()
    assert row["column"] == "x" and row["m"] is None and row["__rows"] == 0 and row["__mean"] is None
