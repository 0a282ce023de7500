"""Coresets of groups that no task may hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import bank as B
from loomlens.operators import coresets as K


def frame(spark, x, category="a"):
    return spark.createDataFrame([(category, i, v.tolist()) for i, v in enumerate(x)], "category string, patch_id long, feature array<double>").repartition(3)


def radius(x, chosen):
    y = x[chosen]
    return max(np.sqrt(((x[a : a + 500, None] - y[None]) ** 2).sum(-1)).min(1).max() for a in range(0, len(x), 500))


def test_greedy_order_takes_each_row_once():
    x = np.array([[0.0], [0.0], [5.0], [5.0], [1.0]])
    chosen, gaps, nearest = K.greedy_order(x, 9, 1)
    assert chosen.tolist() == [1, 2, 4, 0, 3] and gaps.tolist() == [np.inf, 5.0, 1.0, 0.0, 0.0] and (nearest == -1).all()
    assert B.greedy_centers(x, 2, 0)[1].tolist() == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_cells_fit_tasks_and_lose_no_row(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(2500, 5)), np.zeros((900, 5)), 20 + 0.01 * r.normal(size=(600, 5))])
    held = frame(spark, x).withColumn("_keep", F.lit(400).cast("long"))
    cells = K.fitting_cells(held, "category", "patch_id", 300).select("path", "own.k", "size").collect()
    sizes = {}
    for c in cells:
        sizes.setdefault(c.path, []).append(c.size)
    assert sorted(c.k for c in cells) == list(range(4000))
    assert all(len(s) <= 300 and set(s) == {len(s)} for s in sizes.values())


@pytest.mark.parametrize("ratio", [0.1, 0.25])
def test_many_centers_by_quotas(spark, ratio):
    """More centers than a task may hold: as many as asked, a prefix by rank, and a radius near that of the exact choice."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(2200, 4)), 6 + 0.05 * r.normal(size=(1500, 4)), np.full((300, 4), -9.0)])
    keep, found = int(4000 * ratio), {}
    for row in K.coreset_distributed(frame(spark, x), ratio=ratio, rows=500).collect():
        found[row["rank"]] = row.patch_id
    assert sorted(found) == list(range(keep)) and len(set(found.values())) == keep
    for n in (keep, keep // 2):
        exact = K.greedy_order(x, n, 0)[0]
        assert radius(x, [found[i] for i in range(n)]) <= 1.5 * radius(x, exact)
    # The dense cloud gets few centers though it has many rows.
    assert sum(2200 <= i < 3700 for i in found.values()) < keep / 4


def test_groups_of_all_sizes_at_once(spark):
    r = np.random.default_rng(7)
    big, small, copies = (frame(spark, v, c) for v, c in ((r.normal(size=(900, 3)), "big"), (r.normal(size=(40, 3)), "small"), (np.ones((500, 3)), None)))
    found = K.coreset_distributed(big.unionByName(small).unionByName(copies), ratio=0.3, rows=200)
    counts = {row.category: (row.n, row.d) for row in found.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("patch_id").alias("d")).collect()}
    assert counts == {"big": (270, 270), "small": (12, 12), None: (150, 150)}
    exact = {row.patch_id for row in B.coreset(small, ratio=0.3).collect()}
    assert {row.patch_id for row in found.where("category = 'small'").collect()} == exact
    assert K.coreset_distributed(big.limit(0), ratio=0.3).count() == 0


def test_lazy_choice_equals_the_plain_one_and_meets_fewer_rows():
    """order, ties and distances of choice."""
    r = np.random.default_rng(0)
    for x in (r.normal(size=(300, 5)), r.integers(0, 3, size=(300, 3)).astype(float)):
        for keep in (1, 40, 300):
            a, g, _ = K.greedy_order(x, keep, 7)
            b, h = K.lazy_order(x, keep, 7)
            assert a.tolist() == b and np.allclose(g, h)


def test_bank_statistics_take_no_distances_again(spark, monkeypatch):
    monkeypatch.setattr(B, "knn_distances", None)
    rows = spark.createDataFrame([("a", i, [float(i)], 0, "train") for i in range(5)], "category string, patch_id long, feature array<float>, label int, split string")
    assert {r.ratio: r.n_keep for r in B.bank_statistics(rows, [0.4, 1.0]).collect()} == {0.4: 2, 1.0: 5}
