"""Exact nearest neighbours by cells against numpy, and how few pairs they compare."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlens.operators import bank as B
from loomlens.operators import neighbours as N


def frame(spark, groups, vectors, first=0):
    rows = [(g, first + i, v.tolist()) for i, (g, v) in enumerate(zip(groups, vectors, strict=True))]
    return spark.createDataFrame(rows, "category string, patch_id long, feature array<double>").repartition(3)


def truth(bank_groups, bank, g, x, k):
    d = np.sort(np.sqrt(((bank[[h == g for h in bank_groups]] - x) ** 2).sum(axis=1)))[:k]
    return d.mean() if len(d) else None


def clusters(r, n, centers, dims=8, width=0.05):
    return centers[r.integers(0, len(centers), n)] + width * r.normal(size=(n, dims))


@pytest.mark.parametrize("rows", [10_000, 60])
def test_distances_are_exact(spark, rows):
    r = np.random.default_rng(4)
    centers = r.normal(size=(9, 8))
    bank, asked = clusters(r, 700, centers), np.concatenate([clusters(r, 150, centers), r.normal(size=(50, 8))])
    bank[600:] = bank[0]  # a vector that comes a hundred times
    bank_groups = ["a"] * 500 + ["b"] * 2 + [None] * 198
    groups = [["a", "b", None, "none"][i % 4] for i in range(200)]
    found = N.knn_distances(frame(spark, groups, asked), frame(spark, bank_groups, bank), (1, 3), rows=rows).collect()
    assert len(found) == 200
    for f in found:
        assert f.category == groups[f.patch_id]
        for k in (1, 3):
            t = truth(bank_groups, bank, f.category, asked[f.patch_id], k)
            assert f[f"d{k}"] == (t if t is None else pytest.approx(t, abs=1e-9))


def test_cells_that_cannot_improve_are_not_met(spark):
    r = np.random.default_rng(5)
    centers = 10 * r.normal(size=(20, 16))
    bank, asked = clusters(r, 4000, centers, 16), clusters(r, 800, centers, 16)
    found = N.knn_distances(frame(spark, ["a"] * 800, asked), frame(spark, ["a"] * 4000, bank), (1, 3), rows=100, compared=True).collect()
    compared = sum(f.n_compared for f in found)
    assert compared < 800 * 4000 / 5, compared
    for f in found[::40]:
        assert f.d3 == pytest.approx(truth(["a"] * 4000, bank, "a", asked[f.patch_id], 3), abs=1e-9)


def test_empty_sides(spark):
    some, none = frame(spark, ["a"] * 3, np.eye(3)), frame(spark, [], np.zeros((0, 3)))
    assert [r.d1 for r in N.knn_distances(some, none).collect()] == [None] * 3
    assert N.knn_distances(none, some).count() == 0 and N.knn_distances(none, none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([0.01, 1.0, 1000.0]))
def test_bounds_never_exceed_distances(seed, n_pivots, scale):
    r = np.random.default_rng(seed)
    bank, x = scale * r.normal(size=(80, 5)), scale * r.normal(size=(30, 5))
    pivots = bank[r.integers(0, 80, n_pivots)]
    d = N.gaps(bank, pivots)
    cell = d.argmin(axis=1)
    radius = np.array([d[cell == j, j].max(initial=0) if (cell == j).any() else np.inf for j in range(n_pivots)])
    home, bound = N.reachable(N.gaps(x, pivots), pivots, radius, 1e-6 * scale)
    true = np.sqrt(((x[:, None] - bank[None]) ** 2).sum(axis=2))
    for j in range(n_pivots):
        if (cell == j).any():
            assert (bound[:, j] <= true[:, cell == j].min(axis=1)).all()


def marked(spark, groups, vectors, marks, first=0):
    rows = [(g, first + i, v.tolist(), m.tolist()) for i, (g, v, m) in enumerate(zip(groups, vectors, marks, strict=True))]
    return spark.createDataFrame(rows, "category string, patch_id long, feature array<double>, marks array<double>").repartition(3)


@pytest.mark.parametrize(("rows", "width"), [(10_000, 0.5), (40, 4.0), (40, 0.5), (100, 1.0)])
def test_marked_neighbours_against_numpy(spark, rows, width):
    r = np.random.default_rng(7)
    bank, asked, lines = r.normal(size=(420, 6)), r.normal(size=(160, 6)), r.normal(size=(6, 3))
    asked[:40] += 9  # some share nothing
    bank_groups, groups = [["a", "a", None][i % 3] for i in range(420)], [["a", None, "none", "a"][i % 4] for i in range(160)]
    bm, am = np.floor(bank @ lines / width), np.floor(asked @ lines / width)
    found, whole = N.knn_marked(marked(spark, groups, asked, am), marked(spark, bank_groups, bank, bm), rows=rows)
    found, whole = {f.patch_id: f.d1 for f in found.collect()}, {w.category for w in whole.collect()}
    assert rows != 10_000 or whole == {"a", None}
    assert width != 4 or "a" in whole
    for i, g in enumerate(groups):
        own = np.array([h == g for h in bank_groups])
        d = np.sqrt(((bank - asked[i]) ** 2).sum(axis=1))
        near = own & (bm == am[i]).any(axis=1)
        if near.any():
            assert found[i] == pytest.approx(d[near].min(), abs=1e-9)
        elif g in whole:
            assert found[i] == pytest.approx(d[own].min(), abs=1e-9)
        else:
            assert i not in found


def test_approximate_neighbours_alone_in_narrow_buckets(spark):
    r = np.random.default_rng(8)
    bank, asked = r.normal(size=(5000, 4)), r.normal(size=(50, 4)) * 3
    close = {f.patch_id: f.d1 for f in B.knn_approximate(frame(spark, ["a"] * 50, asked), frame(spark, ["a"] * 5000, bank), bucket=1e-3).collect()}
    d = np.sqrt(((asked[:, None] - bank[None]) ** 2).sum(axis=2))
    assert len(close) == 50 and all(d[i].min() - 1e-9 <= close[i] and np.abs(d[i] - close[i]).min() < 1e-9 for i in close)


def test_wide_buckets_send_a_row_once(spark):
    """rows in buckets too large for a task aren't shuffled and written once for each hash table."""
    r = np.random.default_rng(9)
    x = r.normal(size=(9200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    q, b = frame(spark, ["a"] * 4600, x[:4600]).cache(), frame(spark, ["a"] * 4600, x[4600:]).cache()
    q.count(), b.count()
    once = shuffled() - before
    close = {f.patch_id: f.d1 for f in B.knn_approximate(q, b).collect()}
    assert 0 < shuffled() - before - once < 4 * once
    truth = N.nearest(x[:200], x[4600:], 1)[:, 0]
    assert len(close) == 4600 and np.mean([abs(close[i] - t) < 1e-9 for i, t in enumerate(truth)]) >= 0.9
