import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestat as ls
from lodestat.errors import InsufficientData
from lodestat.operators import lyapunov
from lodestat.operators.bds import neighbour_integrals
from lodestat.plans import series as series_plan
from lodestat.plans.nearest import nearest_neighbours
from tests import plain
from tests.conftest import chaotic, correlated


def test_index_is_dense_per_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 2}", (i * 7919) % 1000, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, k string, o int, v double").repartition(7)
    s = ls.index_series(df, "v", ["o", "id"], "k")
    got = {(r["__key0"], r["t"]): (r["x"], r["n"]) for r in s.df.collect()}
    for k in ("hot", "k0", "k1"):
        own = sorted((r[2], r[0], r[3]) for r in rows if r[1] == k)
        assert [got[k, t][0] for t in range(len(own))] == [o[2] for o in own]
        assert got[k, 0][1] == len(own)
    assert (s.count, s.shortest, s.rows) == (3, min(len([1 for r in rows if r[1] == k]) for k in ("hot", "k0", "k1")), 1000)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(30)] + [("a", i, float(i % 5)) for i in range(30)], "k string, t int, v double")
    out = ls.autocorrelation(ls.index_series(df, "v", "t", "k"), 2).collect()
    assert {r["k"] for r in out} == {None, "a"} and len(out) == 4


def test_lags_across_chunks(series, monkeypatch):
    monkeypatch.setattr(series_plan, "CHUNK", 16)
    x = np.array(chaotic(101))
    out = {r["lag"]: r["autocorrelation"] for r in ls.autocorrelation(series(x), 20).collect()}
    d = x - x.mean()
    for k in (1, 7, 16, 20):
        assert out[k] == pytest.approx((d[k:] * d[:-k]).sum() / (d * d).sum())


def test_dependence(series):
    x = chaotic(1000)
    rows = ls.dependence_comparison(series(x), 10).orderBy("lag").collect()
    r, mi = [plain.acf(x, k) for k in range(1, 11)], [plain.information(x, k) for k in range(1, 11)]
    assert [row["autocorrelation"] for row in rows] == pytest.approx(r)
    assert [row["mutual_information"] for row in rows] == pytest.approx(mi)
    stronger = any(m > -0.75 * math.log(1 - c * c) for c, m in zip(r, mi))
    assert stronger and all(row["nonlinear_dominance"] for row in rows)


def test_memory(series):
    x = correlated(1000)
    row = ls.memory_profile(series(x), 10).first()
    partial = plain.pacf(x, 10)
    assert row["partial_autocorrelations"] == pytest.approx(partial)
    assert row["active_information_storage"] == pytest.approx(sum(plain.information(x, k) for k in range(1, 11)))
    assert row["memory_length"] == max(k for k, p in enumerate(partial, 1) if abs(p) > 2 / math.sqrt(1000)) >= 1


def test_constant_series(series):
    rows = ls.dependence_comparison(series([3.0] * 40), 5).collect()
    assert all(r["autocorrelation"] == 0 and r["mutual_information"] == 0 for r in rows)
    assert ls.memory_profile(series([3.0] * 40), 5).first()["partial_autocorrelations"] == [0.0] * 5


@pytest.mark.parametrize("method", ["tiles", "boxes"])
def test_bds(series, method):
    x = chaotic(400)
    row = ls.bds_test(series(x), 3, 0.7, method).first()
    want = plain.bds(x, 3, 0.7)
    assert tuple(row)[:4] == pytest.approx(want[:4])
    # The normal distribution is a rational approximation.
    assert row["p_value"] == pytest.approx(want[4], abs=3e-7)


@pytest.mark.parametrize("method", ["tiles", "boxes"])
@pytest.mark.parametrize("dim", [2, 3])
def test_integrals_with_hot_values(spark, method, dim):
    rng = np.random.default_rng(3)
    data = {"a": rng.integers(0, 9, 150).astype(float), "b": np.where(rng.random(90) < 0.4, 0.0, rng.integers(0, 30, 90))}
    rows = [(k, i, float(v)) for k, xs in data.items() for i, v in enumerate(xs)]
    s = ls.index_series(spark.createDataFrame(rows, "k string, t int, v double"), "v", "t", "k")
    got = {r["__key0"]: r for r in neighbour_integrals(s, dim, 2.0, method).collect()}
    for k, x in data.items():
        near = np.abs(x[:, None] - x[None, :]) < 2.0
        n = len(x) - dim + 1
        both = np.logical_and.reduce([near[d : d + n, d : d + n] for d in range(dim)])
        assert got[k]["cm"] == pytest.approx((both.sum() - n) / (n * (n - 1)))
        assert got[k]["k"] == pytest.approx(((near.sum(axis=1) / len(x)) ** 2).mean())


NEIGHBOUR_CASES = {
    "chaos": (chaotic(260), 3, 1),
    "ties": ([float((i * i) % 11) for i in range(240)], 2, 2),
    "hot": ([0.0 if i % 3 == 0 else float((i * 37) % 101) for i in range(240)], 1, 1),
    "outlier": ([1e6 if i == 100 else math.sin(i) for i in range(200)], 2, 3),
}


@pytest.mark.parametrize("method", ["tiles", "tree"])
@pytest.mark.parametrize("case", NEIGHBOUR_CASES)
def test_nearest_neighbours(series, case, method):
    x, dim, tau = NEIGHBOUR_CASES[case]
    got = {r["i"]: r["j"] for r in nearest_neighbours(series(x), dim, tau, method).collect()}
    assert got == plain.neighbours(x, dim, tau)


@pytest.mark.parametrize("method", ["tiles", "tree"])
def test_lyapunov(series, method):
    x = chaotic(700)
    assert ls.lyapunov_exponent(series(x), 3, 1, method).first()[0] == pytest.approx(plain.lyapunov(x, 3, 1))


@pytest.mark.parametrize("values", [chaotic(600), correlated(300), [math.sin(0.1 * i) + 0.3 * math.sin(0.037 * i) for i in range(500)]])
def test_delay_embedding(series, values):
    tau = plain.delay(values)
    assert tuple(ls.delay_embedding(series(values), 6).first()) == (tau, plain.dimension(values, tau, 6))


def test_delays_of_different_length(spark):
    """Lags go up in blocks, each only for the series that have no minimum yet."""
    from lodestat.operators.embedding import optimal_delay

    made = {k: [math.sin(i / k) + 1e-3 * ((i * 37) % 11) for i in range(n)] for k, n in ((1, 200), (8, 400), (13, 600), (90, 300), (5, 50))}
    rows = [(k, i, v) for k, xs in made.items() for i, v in enumerate(xs)]
    s = ls.index_series(spark.createDataFrame(rows, "k int, t int, v double"), "v", "t", "k")
    got = {r["__key0"]: r["tau"] for r in optimal_delay(s).collect()}
    want = {k: plain.delay(xs) for k, xs in made.items()}
    assert got == want and min(want.values()) <= 8 < max(want.values())


@pytest.mark.parametrize("values", [chaotic(500), correlated(500), [0.5 * i + math.cos(i) for i in range(300)]])
def test_surrogates(series, values):
    row = ls.surrogate_test(series(values), 20).first()
    real, mean, spread = plain.surrogates(values, 20)
    assert tuple(row)[:3] == pytest.approx((real, mean, spread), rel=1e-6, abs=1e-9)
    assert row["is_nonlinear"] == (abs((real - mean) / spread) > 2)


@pytest.mark.parametrize("fan_in", [2, 7, 2048])
def test_surrogates_do_not_depend_on_chunks(series, monkeypatch, fan_in):
    from lodestat.operators import surrogate

    monkeypatch.setattr(surrogate, "TILE", 37)
    monkeypatch.setattr(surrogate, "FAN_IN", fan_in)
    got = ls.surrogate_test(series(chaotic(600), 1), 5).first()
    assert tuple(got)[:3] == pytest.approx(plain.surrogates(chaotic(600), 5), rel=1e-6)


def test_surrogates_in_blocks_and_spans(series, monkeypatch):
    from lodestat.operators import surrogate

    for name, rows in (("TILE", 37), ("BLOCK", 50), ("SPAN", 3)):
        monkeypatch.setattr(surrogate, name, rows)
    got = ls.surrogate_test(series(chaotic(600), 1), 5).first()
    assert tuple(got)[:3] == pytest.approx(plain.surrogates(chaotic(600), 5), rel=1e-6)


def test_residuals_travel_in_few_bytes():
    """A residual of a surrogate takes 14 bytes and not a row of its own."""
    import zlib

    from lodestat.operators import surrogate

    h = np.sort(surrogate.hash_order(1, 0, [b"%d" % t for t in range(16_384)]))
    gaps = surrogate.packed_gaps(h)
    assert surrogate.unpacked_gaps(int(h[0]), gaps).tolist() == h.tolist()
    assert len(zlib.compress(gaps, 1)) < 6.2 * len(h)


def test_regimes(series):
    x = [0.0]
    for i in range(600):
        x.append((0.8 if x[-1] > 0 else -0.5) * x[-1] + math.sin(i * i))
    assert ls.regime_switching(series(x)).first()["delta_log_likelihood"] > 50


def test_lengths(series):
    short = series(range(9))
    for run in (
        lambda: ls.surrogate_test(short),
        lambda: ls.bds_test(short, 2, 1.0),
        lambda: ls.lyapunov_exponent(short, 2, 1),
        lambda: ls.delay_embedding(short, 3),
        lambda: ls.dependence_comparison(short, 3),
        lambda: ls.memory_profile(series(range(40)), 0),
        lambda: ls.bds_test(series(range(40)), 1, 1.0),
    ):
        with pytest.raises(InsufficientData):
            run()


@pytest.mark.parametrize("method", ["tiles", "boxes"])
@pytest.mark.parametrize("dim", [2, 3])
def test_neighbours_exactly_epsilon_apart(series, method, dim):
    from lodestat.operators.bds import neighbour_integrals

    x, eps = [((7 * i * i + 3 * i) % 101) / 10 - 5 for i in range(300)], 0.3
    close = lambda a, b: all(abs(p - q) < eps for p, q in zip(a, b))
    share = lambda v: sum(close(a, b) for a in v for b in v if a is not b) / (len(v) * (len(v) - 1))
    near = [sum(abs(a - b) < eps for b in x) for a in x]
    want = (share([(a,) for a in x]), share([tuple(x[i : i + dim]) for i in range(len(x) - dim + 1)]), sum(n * n for n in near) / len(x) ** 3)
    row = neighbour_integrals(series(x), dim, eps, method).first()
    assert (row["c1"], row["cm"], row["k"]) == pytest.approx(want, abs=1e-12)


def test_tracks_meet_few_chunks(series, monkeypatch):
    """The chunk pairs that receive arrays are as many for a long series as for one four times shorter."""
    monkeypatch.setattr(lyapunov, "TILE", 16)
    monkeypatch.setattr(lyapunov, "SPANS", 8)
    x = chaotic(1200)
    for n in (300, 1200):
        s = series(x[:n])
        assert lyapunov.met_tracks(s, nearest_neighbours(s, 2, 1), 2, 1).count() <= 64
    got = {r["step"]: r["mean_log"] for r in lyapunov.divergence(s, nearest_neighbours(s, 2, 1), 2, 1).collect()}
    v, near = np.stack([x[:-1], x[1:]], axis=1), plain.neighbours(x, 2, 1)
    for step in (0, 7, 28):
        gaps = [math.dist(v[i + step], v[j + step]) for i, j in near.items() if max(i, j) + step < len(v)]
        assert got[step] == pytest.approx(np.mean(np.log([g for g in gaps if g > 0])))


def test_tracks_over_blocks_of_steps(series, monkeypatch):
    s = series(chaotic(1500))
    pairs = nearest_neighbours(s, 3, 2)
    whole = {r["step"]: r["mean_log"] for r in lyapunov.divergence(s, pairs, 3, 2).collect()}
    monkeypatch.setattr(lyapunov, "TILE", 16)
    monkeypatch.setattr(lyapunov, "MOST_ROWS", 16)
    assert {r["step"]: r["mean_log"] for r in lyapunov.divergence(s, pairs, 3, 2).collect()} == pytest.approx(whole)


@pytest.mark.parametrize("dim, tau", [(1, 1), (2, 1), (3, 2)])
@pytest.mark.parametrize("kind", ["noise", "tied", "huge", "tiny", "mixed", "infinite"])
def test_products_of_distances(monkeypatch, kind, dim, tau):
    """Logs of products equal sums of logs, also where distances are 0 or products leave the range of doubles."""
    monkeypatch.setattr(lyapunov, "STRETCH", 50)
    rng, n, count = np.random.default_rng(3), 700, 120
    made = {
        "noise": lambda k: np.round(rng.exponential(50, k), 2),
        "tied": lambda k: rng.integers(0, 3, k).astype(float),
        "huge": lambda k: rng.normal(size=k) * 1e80,
        "tiny": lambda k: rng.normal(size=k) * 1e-60,
        "mixed": lambda k: rng.normal(size=k) * 10.0 ** rng.integers(-70, 40, k),
        "infinite": lambda k: np.where(rng.random(k) < 0.01, np.inf, rng.normal(size=k)),
    }[kind]
    reach = (dim - 1) * tau
    x, y = made(n + count + reach), made(n + count + reach)
    u, v, weight = rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(1, 3, 60)
    ends = np.minimum(rng.integers(1, 2 * count, 60), n + count - np.maximum(u, v))
    total, seen = np.zeros(count), np.zeros(count, int)
    with np.errstate(all="ignore"):
        for a, b, end, w in zip(u, v, ends, weight):
            for step in range(min(end, count)):
                gap = sum((x[a + step + k * tau] - y[b + step + k * tau]) ** 2 for k in range(dim))
                if gap > 0:
                    total[step] += w * np.log(np.sqrt(gap))
                    seen[step] += w
    got = lyapunov.log_sums(x, y, u, v, ends, weight, dim, tau, count)
    assert got[1].tolist() == seen.tolist()
    assert got[0] == pytest.approx(total, rel=1e-11, abs=1e-9)


def test_mutual_neighbours_are_followed_once(spark, series, monkeypatch):
    """Rows that are each other's neighbours share a track, and chunks sent to bins give what broadcast ones give."""
    s = series([float((i * i) % 97) for i in range(1500)])
    pairs = nearest_neighbours(s, 2, 1).localCheckpoint()
    monkeypatch.setattr(lyapunov, "TILE", 64)
    met = lyapunov.met_tracks(s, pairs, 2, 1)
    assert met.where("a > b").count() == 0
    whole = {r["step"]: r["mean_log"] for r in lyapunov.divergence(s, pairs, 2, 1).collect()}
    monkeypatch.setattr(lyapunov, "BROADCAST_VALUES", 0)
    assert {r["step"]: r["mean_log"] for r in lyapunov.divergence(s, pairs, 2, 1).collect()} == pytest.approx(whole)
    twice = spark.createDataFrame([(i, j) for i, j in ((3, 900), (900, 3), (40, 700))], "i long, j long").withColumn("__key0", F.lit(0)).withColumn("n", F.lit(1500).cast("long"))
    x = np.array([float((i * i) % 97) for i in range(1500)])
    gaps = [math.hypot(x[i] - x[j], x[i + 1] - x[j + 1]) for i, j in ((3, 900), (3, 900), (40, 700))]
    assert {r["step"]: r["mean_log"] for r in lyapunov.divergence(s, twice, 2, 1).collect()}[0] == pytest.approx(np.mean(np.log(gaps)))


def test_chunks_sent_to_bins_for_odd_keys(spark, monkeypatch):
    """Series of different length, NULL and NaN keys keep their own sums."""
    rows = [(k, i, math.sin(i * i + (0 if k is None else 3))) for k, n in ((None, 300), (float("nan"), 500), (1.5, 90)) for i in range(n)]
    s = ls.index_series(spark.createDataFrame(rows, "k double, t int, v double"), "v", "t", "k")
    values = lambda: {repr(r["k"]): r["lyapunov_exponent"] for r in ls.lyapunov_exponent(s, 2, 1).collect()}
    want = values()
    monkeypatch.setattr(lyapunov, "TILE", 16)
    monkeypatch.setattr(lyapunov, "BROADCAST_VALUES", 0)
    assert values() == pytest.approx(want) and len(want) == 3
