"""Counting close vectors by bitsets of tiles, against the comparison of all pairs."""

import numpy as np
import pytest

from lodestat.plans import tiles
from lodestat.operators.bds import neighbour_integrals
from lodestat.plans import boxcount
from lodestat.plans.boxcount import far_end


def plain_count(a, b, dim, eps, same):
    with np.errstate(invalid="ignore"):
        near = np.abs(a[:, None] - b[None, :]) < eps
    rows, cols = len(a) - dim + 1, len(b) - dim + 1
    if rows < 1 or cols < 1:
        return 0
    both = np.logical_and.reduce([near[k : k + rows, k : k + cols] for k in range(dim)])
    return int(np.triu(both, 1).sum() if same else both.sum())


@pytest.mark.parametrize("dim", [1, 2, 5, 70])
@pytest.mark.parametrize("odd", [np.nan, np.inf, -np.inf])
def test_tiles_count_all_pairs(monkeypatch, dim, odd):
    monkeypatch.setattr(tiles, "TILE", 64)
    rng = np.random.default_rng(dim)
    for eps in (0.3, 1.0, 0.0, 1e9, np.inf):
        for n, m in ((1, 1), (64, 128), (200, 63), (290, 290)):
            a, b = (np.round(rng.integers(0, 30, k) / 10, 1) for k in (n, m))
            for x in (a, b):
                x[rng.random(len(x)) < 0.02] = odd
            low, high = far_end(a, eps, -1), far_end(a, eps, 1)
            assert tiles.near_tile(low, high, b, dim, False) == plain_count(a, b, dim, eps, False)
            assert tiles.near_tile(low, high, a, dim, True) == plain_count(a, a, dim, eps, True)


@pytest.mark.parametrize("size", [50, 128])
def test_pairs_of_chunks_that_lie_apart(monkeypatch, series, size):
    monkeypatch.setattr(tiles, "TILE", size)
    x = np.round(np.arange(700) * 0.05 + np.random.default_rng(4).normal(size=700), 2)
    row = tiles.near_pairs(series(x), 3, 0.5).first()
    assert row["near"] == plain_count(x, x, 3, 0.5, True) > 0


def test_series_without_a_pair(series):
    assert tiles.near_pairs(series([float(i) for i in range(100)]), 2, 0.5).first()["near"] == 0


@pytest.mark.parametrize("dim", [2, 3, 4])
def test_boxes_in_blocks_and_heavy_nodes(series, monkeypatch, dim):
    """Shuffled rows stay few where ranks are split inside tasks, and heavy nodes are dealt without losing pairs."""
    monkeypatch.setattr(boxcount, "BLOCK_POINTS", 40)
    monkeypatch.setattr(boxcount, "PART", 30)
    x = np.where(np.arange(400) % 3 == 0, 2.0, [((7 * i * i + 3 * i) % 211) / 10 for i in range(400)])
    near = np.abs(x[:, None] - x[None, :]) < 3.0
    n = len(x) - dim + 1
    both = np.logical_and.reduce([near[d : d + n, d : d + n] for d in range(dim)])
    s = series(x)
    got = neighbour_integrals(s, dim, 3.0, "boxes").first()["cm"]
    assert got == pytest.approx((both.sum() - n) / (n * (n - 1)))


def test_weights_inside():
    rng = np.random.default_rng(5)
    values, weights = rng.integers(0, 50, 300), rng.integers(1, 4, 300)
    start = rng.integers(0, 300, 200)
    end, lo, hi = rng.integers(start, 301), rng.integers(0, 50, 200), rng.integers(0, 60, 200)
    hi = np.maximum(lo, hi)
    want = [weights[a:b][(values[a:b] >= c) & (values[a:b] < d)].sum() for a, b, c, d in zip(start, end, lo, hi)]
    assert boxcount.weights_inside(values, weights, start, end, lo, hi).tolist() == want


def test_long_series_go_to_tiles():
    """Boxes repeat rows for the parts of heavy nodes: five series of 7,200,000 rows and 10,000 values are left to tiles."""
    rows = 7_200_000
    assert tiles.tile_seconds(5.0 * rows**2) <= boxcount.box_seconds(5 * rows, 10_000, 3)


@pytest.mark.parametrize("dim", [2, 3])
def test_chunks_sent_to_tasks(spark, monkeypatch, dim):
    """Both chunks of a pair meet once, for series of different length with NULL and NaN as keys."""
    import lodestat as ls

    rng = np.random.default_rng(6)
    made = {None: rng.integers(0, 60, 700) / 2, float("nan"): np.round(rng.normal(size=300), 1), 1.5: np.arange(90) * 0.1}
    rows = [(k, i, float(v)) for k, xs in made.items() for i, v in enumerate(xs)]
    s = ls.index_series(spark.createDataFrame(rows, "k double, t int, v double"), "v", "t", "k")
    monkeypatch.setattr(tiles, "TILE", 64)
    monkeypatch.setattr(tiles, "BROADCAST_VALUES", 0)
    got = {repr(r["__key0"]): r["near"] for r in tiles.near_pairs(s, dim, 0.7).collect()}
    assert got == {repr(k): plain_count(x, x, dim, 0.7, True) for k, x in made.items()}


def test_places_that_are_covered_or_apart(monkeypatch):
    """Blocks whose vectors all lie near or apart in some place are counted without their bits."""
    monkeypatch.setattr(tiles, "TILE", 32)
    rng = np.random.default_rng(9)
    a = np.concatenate([rng.random(200), 10 + rng.random(200)])[rng.permutation(400)]
    for eps in (0.2, 1.5, 9.5, 30.0):
        for x in (a, np.sort(a)):
            low, high = far_end(x, eps, -1), far_end(x, eps, 1)
            assert tiles.near_tile(low, high, a, 3, False) == plain_count(x, a, 3, eps, False)
            assert tiles.near_tile(low, high, x, 3, True) == plain_count(x, x, 3, eps, True)
