"""Space partition: balanced leaves, exact neighbours, bounded work."""

import math

import numpy as np
import pytest

from lodestat.plans import spacetree
from lodestat.plans.nearest import nearest_neighbours
from tests import plain

RNG = np.random.default_rng(11)
SHAPES = {
    "normal": lambda n: RNG.normal(size=n),
    "heavy": lambda n: RNG.standard_t(1.2, size=n),
    "outlier": lambda n: np.where(np.arange(n) == n // 3, 1e9, RNG.normal(size=n)),
    "tied": lambda n: np.where(RNG.random(n) < 0.6, 0.0, RNG.integers(0, 40, n)),
}


@pytest.mark.parametrize("shape, dim, tau", [("normal", 2, 1), ("heavy", 1, 1), ("outlier", 2, 1), ("tied", 3, 2)])
def test_tree_finds_what_all_pairs_find(series, monkeypatch, shape, dim, tau):
    monkeypatch.setattr(spacetree, "LEAF", 8)
    monkeypatch.setattr(spacetree, "FAN", 8)
    monkeypatch.setattr(spacetree, "PART", 64)
    x = SHAPES[shape](900)
    got = {r["i"]: r["j"] for r in nearest_neighbours(series(x), dim, tau, "tree").collect()}
    assert got == plain.neighbours(x, dim, tau)


def test_null_and_many_keys(spark):
    import lodestat as ls

    rows = [(k, i, math.sin(i * i + len(k or ""))) for k in (None, "a", "hot") for i in range(300 if k == "hot" else 60)]
    s = ls.index_series(spark.createDataFrame(rows, "k string, t int, v double"), "v", "t", "k")
    found = nearest_neighbours(s, 2, 1, "tree").collect()
    for k in (None, "a", "hot"):
        got = {r["i"]: r["j"] for r in found if r["__key0"] == k}
        assert got == plain.neighbours([r[2] for r in rows if r[0] == k], 2, 1)


@pytest.mark.parametrize("shape", ["normal", "heavy", "outlier"])
def test_visits_grow_with_the_points(shape):
    """Compared vectors stay below 2.5 times as many for twice the points, whatever the distribution."""

    def compared(n):
        x = SHAPES[shape](n + 1)
        v = np.stack([x[:-1], x[1:]], axis=1)
        tree = spacetree.split_tree(v[RNG.permutation(n)[: 16 * (n // 256)]], n // 256)
        arrays = tuple(np.asarray(tree[c]) for c in ("axes", "cuts", "low", "high"))
        home = spacetree.descend(arrays, v)
        size = np.bincount(home)
        assert size.max() < 4 * 256
        radius = np.zeros(n)
        for leaf in range(len(size)):
            at = np.flatnonzero(home == leaf)
            row, d, _ = spacetree.closest(v[at], np.full(len(at), np.inf), v[at], np.arange(len(at) + 1), at, 4)
            np.maximum.at(radius, at[row], d)
        row, leaf, _ = spacetree.reached(arrays, v, np.zeros_like(v), radius)
        return size[leaf].sum()

    assert compared(32_768) < 2.5 * compared(16_384)


def test_split_of_equal_coordinates():
    points = np.array([[0.0, float(i)] for i in range(64)] + [[5.0, 0.0]])
    tree = spacetree.split_tree(points, 8)
    arrays = tuple(np.asarray(tree[c]) for c in ("axes", "cuts", "low", "high"))
    sizes = np.bincount(spacetree.descend(arrays, points))
    assert sizes.max() <= 16 and sizes.sum() == 65
    assert spacetree.split_tree(np.zeros((9, 2)), 4)["axes"] == []
