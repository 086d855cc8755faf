import numpy as np
import pytest

import lodestat as ls
from lodestat.errors import ColumnNotFound, EmptyDataset


def by_column(df, value):
    return {r["column"]: r[value] for r in df.collect()}


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def plain_entropy(values):
    v = np.array([0.0 if x is None else x for x in values], dtype=float)
    if v.max() - v.min() < 2.2e-16:
        return 0.0
    s, n = np.sort(v), len(v)
    iqr = s[3 * n // 4] - s[n // 4]
    bins = max(np.ceil((v.max() - v.min()) / (2 * iqr * n ** (-1 / 3))), 2) if iqr > 2.2e-16 else np.ceil(np.log2(n)) + 1
    width = (v.max() - v.min()) / bins
    spot = np.minimum(np.floor((v - v.min()) / width), bins - 1)
    p = np.unique(spot, return_counts=True)[1] / n
    return float(-(p * np.log(p / width)).sum())


def test_profile_of_sample(sample):
    rows = {r["column"]: r for r in ls.profile(sample).collect()}
    age, score = rows["age"], rows["score"]
    assert age["mean"] == pytest.approx(31.4)
    assert age["variance"] == pytest.approx(50.933333, abs=1e-6)
    assert (age["min"], age["q25"], age["median"], age["q75"], age["max"]) == (22, 25.75, 30.5, 34.5, 45)
    assert age["skewness"] == pytest.approx(0.689777, abs=1e-6)
    assert score["sparsity"] == pytest.approx(0.4)
    assert score["entropy"] == pytest.approx(4.533741, abs=1e-6)
    assert rows["income"]["entropy"] == pytest.approx(10.810066, abs=1e-6)


def test_counts_and_types(sample, gaps):
    assert ls.row_count(sample).first()["rows"] == 10
    assert ls.column_count(sample, target="score").first()["columns"] == 3
    assert [r["column"] for r in ls.column_types(gaps).orderBy("position").collect()] == ["id", "a", "b", "c", "k"]


def test_null_rules(gaps):
    a = column(gaps, "a")
    present = np.array([x for x in a if x is not None])
    assert by_column(ls.mean(gaps, "a"), "mean")["a"] == pytest.approx(present.mean())
    assert by_column(ls.variance(gaps, "a"), "variance")["a"] == pytest.approx(present.var(ddof=1))
    c = column(gaps, "c")
    assert by_column(ls.sparsity(gaps, "c"), "sparsity")["c"] == pytest.approx(sum(x == 0 for x in c) / len(c))
    assert by_column(ls.entropy(gaps, "a"), "entropy")["a"] == pytest.approx(plain_entropy(a))


@pytest.mark.parametrize("bracket_rows", [1, 10, 65_536])
def test_quantiles_with_buckets_cut_again(gaps, bracket_rows):
    out = {r["column"]: r for r in ls.quantiles(gaps, ["a", "b", "c"], bracket_rows=bracket_rows).collect()}
    for c in ("a", "b", "c"):
        v = np.array([x for x in column(gaps, c) if x is not None], dtype=float)
        want = [v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()]
        assert [out[c][k] for k in ("min", "q25", "median", "q75", "max")] == pytest.approx(want)


@pytest.mark.parametrize("bracket_rows", [1, 65_536])
def test_entropy_by_group(gaps, bracket_rows):
    got = {(r["grp"], r["column"]): r["entropy"] for r in ls.entropy(gaps, ["a", "b", "k"], by="grp", bracket_rows=bracket_rows).collect()}
    rows = gaps.collect()
    for g in {r["grp"] for r in rows}:
        for c in ("a", "b", "k"):
            assert got[g, c] == pytest.approx(plain_entropy([r[c] for r in rows if r["grp"] == g]), abs=1e-9)


def test_undefined_statistics_are_zero(spark):
    none = spark.createDataFrame([(None,), (None,)], "x double")
    row = ls.column_stats(none, ["mean", "variance", "skewness", "kurtosis", "min"]).first()
    assert [row[k] for k in ("mean", "variance", "skewness", "kurtosis", "min")] == [0.0] * 5
    empty = spark.createDataFrame([], "x double")
    assert ls.mean(empty).first()["mean"] == 0.0
    assert ls.quantiles(empty).first()["median"] == 0.0
    with pytest.raises(EmptyDataset):
        ls.sparsity(empty)
    with pytest.raises(EmptyDataset):
        ls.entropy(empty)


def test_unknown_column(gaps):
    for name in ("nope", "grp"):
        with pytest.raises(ColumnNotFound):
            ls.mean(gaps, name)


def test_unique_count(gaps):
    assert by_column(ls.unique_count(gaps, ["b", "grp"]), "unique_count") == {"b": len({x for x in column(gaps, "b") if x is not None}), "grp": 5}
    assert by_column(ls.unique_count(gaps, ["grp"], rsd=0.05), "unique_count")["grp"] == 5


def test_same_profile_for_any_partitioning(gaps):
    want = ls.profile(gaps.coalesce(1), ["a", "b"]).toPandas().set_index("column")
    for parts in (4, 16):
        got = ls.profile(gaps.repartition(parts), ["a", "b"]).toPandas().set_index("column")
        assert np.allclose(got.loc[want.index].to_numpy(dtype=float), want.to_numpy(dtype=float))


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], ["a b`c", "x.y"])
    assert by_column(ls.mean(df), "mean") == {"a b`c": 2.0, "x.y": 3.5}
    assert by_column(ls.entropy(df), "entropy").keys() == {"a b`c", "x.y"}
