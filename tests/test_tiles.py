"""Counts and nearest points by tiles against all pairs, in tiles of any fullness."""

import numpy as np
import pytest

from mixfield.operators import spatial, tiles


def points_of(spark, n=220, seed=5):
    """Points on a coarse grid, so that many are at one place or exactly a radius apart, and a few that are no place at all."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-20, 20, (n // 2, 2)) * 5.0, rng.normal(0, 8, (n - n // 2, 2)).round(1)])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(n, float("nan"), 0.0), (n + 1, None, 1.0), (n + 2, float("inf"), 1.0)]
    return x, spark.createDataFrame(rows, "id long, x double, y double").repartition(3)


def squared(x):
    return ((x[:, None] - x) ** 2).sum(axis=2)


@pytest.mark.parametrize("most", [tiles.MOST, 60])
def test_tiles_are_all_pairs(spark, monkeypatch, most):
    """``most`` 60 cuts full tiles, and leaves those that stay full to joins."""
    monkeypatch.setattr(tiles, "MOST", most)
    x, points = points_of(spark)
    d2 = squared(x)
    n = (d2 <= 100).sum(axis=1)
    assert {r.id: r.n for r in spatial.neighbour_counts(points, 10.0).collect()} == dict(enumerate(n))
    assert {r.id: r.n for r in spatial.counts_within(points, points, 10.0, how_close="<").collect()} == dict(enumerate((d2 < 100).sum(axis=1)))
    apart = np.where((d2 > 0) & (d2 <= 400), d2, np.inf)
    found = {r.id: (r.other, r.d) for r in spatial.nearest_neighbour(points, 20.0).collect()}
    assert found == {i: (int(apart[i].argmin()), float(np.sqrt(apart[i].min()))) for i in range(len(x)) if apart[i].min() < np.inf}
    rank = np.empty(len(x), int)
    rank[np.lexsort((np.arange(len(x)), -n))] = np.arange(len(x))
    denser = np.where((rank[None] < rank[:, None]) & (d2 <= 900), d2, np.inf).min(axis=1)
    found = {r.id: r.delta for r in spatial.density_peaks(points, 10.0).collect()}
    assert all(found[i] == (np.sqrt(denser[i]) if denser[i] < np.inf else 50.0) for i in range(len(x)) if rank[i] > 0)


def test_no_row_for_a_pair_or_a_cell(spark):
    """A point is shuffled to its tile and to few more, whatever the number of cells in its circle."""
    _, points = points_of(spark)
    for found in (spatial.neighbour_counts(points, 10.0), spatial.nearest_neighbour(points, 20.0)):
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_three_dimensions():
    rng = np.random.default_rng(7)
    x, y = rng.uniform(-9, 9, (300, 3)), rng.uniform(-9, 9, (200, 3))
    d2 = ((x[:, None] - y) ** 2).sum(axis=2)
    assert (tiles.counted(x, y, 4.0) == (d2 <= 16).sum(axis=1)).all()
    best, key = tiles.nearest(x, None, y, np.arange(200), 4.0)
    near = d2.min(axis=1) <= 16
    assert (key[near] == d2[near].argmin(axis=1)).all() and np.isinf(best[~near]).all()


def test_far_from_zero():
    """Coordinates so large that a radius has few digits left."""
    x = np.c_[1e12 + np.arange(50) * 0.5, 1e12 + np.arange(50) % 7]
    assert (tiles.counted(x, x, 3.0) == (squared(x) <= 9).sum(axis=1)).all()
