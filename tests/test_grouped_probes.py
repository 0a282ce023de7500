"""Probes of all groups in one job against single fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import grouped_probes as G
from loomlens.operators import typing_probe as Y


def rows_of(seed=3, n=90, dims=3, classes=3):
    r = np.random.default_rng(seed)
    centers = {c: r.normal(size=(classes, dims)) * s for c, s in (("a", 1.0), ("b", 3.0), (None, 0.3))}
    out = []
    for i in range(n * 3):
        c = ["a", "b", None][i % 3]
        y = int(r.choice(classes, p=[0.5, 0.3, 0.2]))
        out.append((i, c, y, [*(centers[c][y] + r.normal(size=dims)).tolist(), 7.0]))  # the last doesn't vary
    return out


SCHEMA = "id long, category string, y int, features array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


def test_fits_equal_those_of_single_groups(rows):
    probes = G.fit_probes(rows, ["category"], 3)
    assert probes.count() == 3
    found = {r.id: r.proba for r in G.probabilities(rows, probes, ["category"]).collect()}
    assert len(found) == 270
    for c in ("a", "b", None):
        own = rows.where(F.col("category").eqNullSafe(F.lit(c)))
        single = {r.id: r.proba for r in Y.probabilities(Y.train_probe(own), own).collect()}
        assert max(np.abs(np.array(single[i]) - np.array(found[i])).max() for i in single) < 2e-4


def test_groups_of_many_blocks_give_the_same_fit(rows, monkeypatch):
    """Rounds over sums of blocks end where the steps on one block do."""
    some = rows.where("category is not null")
    coef = lambda df: {r.model: r.probe.coef for r in df.collect()}
    one = coef(G.fit_probes(some, ["category"], 3, tolerance=1e-7))
    monkeypatch.setattr(G, "BLOCK", 40)
    two = coef(G.fit_probes(some, ["category"], 3, tolerance=1e-7))
    assert len(one) == 2 and all(np.allclose(one[m], two[m], atol=1e-4) for m in one)


def test_gradient_vanishes_at_the_fit():
    """The minimum by its definition, in numpy."""
    r = np.random.default_rng(1)
    z = np.concatenate([r.normal(size=(50, 4)), np.ones((50, 1))], axis=1)
    y, w = np.eye(3)[r.integers(0, 3, 50)], r.random(50) + 0.5
    state = {"model": "m", "reg": 0.02, "mean": [0.0] * 4, "scale": [1.0] * 4, "classes": 3, "present": [1.0] * 3, "at": np.zeros(15), "trial": np.zeros(15), "loss": None, "slope": None, "moves": np.zeros(0), "turns": np.zeros(0), "metric": None, "left": True}
    for n in range(200):
        p = G._softmax(z, np.array(state["trial"]).reshape(3, 5), np.ones(3, bool))
        loss, grad = -(w[:, None] * y * np.log(p)).sum(), ((w[:, None] * (p - y)).T @ z).ravel()
        state = G._advance(state, np.concatenate([[loss, w.sum()], grad, ((w[:, None] * z).T @ z).ravel()]), 1e-10)
        if not state["left"]:
            break
    assert n < 60 and np.abs(state["slope"]).max() < 1e-10


def test_a_class_that_a_group_lacks(spark):
    data = [(i, "a" if i < 30 else "b", i % 2 if i < 30 else i % 3, [float(i % 2), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    found = G.probabilities(df, G.fit_probes(df, ["category"], 3), ["category"]).collect()
    assert all(r.proba[2] == 0 for r in found if r.category == "a") and any(r.proba[2] > 0.5 for r in found if r.category == "b")


def test_folds_are_even_in_each_class_and_group(rows, spark):
    found = G.stratified(rows, ["category"]).groupBy("category", "y", "fold").count().collect()
    per = {}
    for r in found:
        per.setdefault((r.category, r.y), []).append(r["count"])
    assert len(per) == 9 and all(len(v) == 5 and max(v) - min(v) <= 1 for v in per.values())
    lone = spark.createDataFrame([(1, "c", 0, [0.0]), (2, "c", 1, [1.0]), (3, "c", 1, [1.0])], SCHEMA)
    assert G.stratified(lone, ["category"]).count() == 0


def test_out_of_fold_calibrated(rows):
    found = G.out_of_fold(rows, ["category"], 3).collect()
    assert sorted(r.id for r in found) == list(range(270)) and {r.fold for r in found} == set(range(5))
    assert all(sum(r.proba) == pytest.approx(1) for r in found)
    right = {c: np.mean([int(np.argmax(r.proba)) == r.y for r in found if r.category == c]) for c in ("a", "b")}
    assert right["b"] > 0.9 and right["a"] > 0.5
    # No model of a row's fold has seen the row: labels turned about in one fold change nothing there.
    turned = rows.join(G.stratified(rows, ["category"]).select("id", "fold"), "id").withColumn("features", F.when(F.col("fold") == 0, F.array([F.lit(0.0)] * 4)).otherwise(F.col("features"))).drop("fold")
    other = {r.id: r.proba for r in G.out_of_fold(turned, ["category"], 3, calibrate=False).collect() if r.fold == 0}
    before = {r.id: r.proba for r in G.out_of_fold(rows, ["category"], 3, calibrate=False).collect() if r.fold == 0}
    assert other.keys() == before.keys()


def test_sigmoids_solve_their_equations(rows):
    """At the fitted a and b the two sums of the calibrator's residuals are 0."""
    only = rows.where("category = 'a'")
    folds = {r.id: r["_inner"] for r in G.stratified(only, ["category"], name="_inner").collect()}
    members = G.fit_calibrated(only, ["category"], 3).collect()
    assert len(members) == 5
    data = {r.id: r for r in only.collect()}
    for m in members:
        p = m.probe
        raw = {i: G._softmax(G._design(np.array([r.features]), p.mean, p.scale), np.array(p.coef).reshape(3, -1), np.array(p.present) > 0)[0] for i, r in data.items()}
        best = []
        for k in range(5):
            ids = [i for i in data if folds[i] == k]
            x, y = np.array([raw[i] for i in ids]), np.array([data[i].y for i in ids])
            sums = []
            for c in range(3):
                pos = (y == c).sum()
                t = np.where(y == c, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
                e = 1 / (1 + np.exp(-(p.a[c] * x[:, c] + p.b[c]))) - t
                sums += [abs(e.sum()), abs((e * x[:, c]).sum())]
            best.append(max(sums))
        assert min(best) < 1e-5


def test_calibrated_probes_are_saved(rows, spark, tmp_path):
    probes = G.fit_calibrated(rows, ["category"], 3)
    G.save_probes(probes, str(tmp_path), ["hole", "stain", "slub"], 0.6)
    again, labels, threshold = G.load_probes(spark, str(tmp_path))
    first, second = ({r.id: r.proba for r in G.probabilities(rows, p, ["category"]).collect()} for p in (probes, again))
    assert all(np.allclose(first[i], second[i], atol=1e-12) for i in first) and len(first) == 270
    assert labels == ["hole", "stain", "slub"] and threshold == 0.6


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    """what is fitted grows with the different rows, not with the rows."""
    some = [(c, y, [float(a), float(a * y % 3), 0.1]) for c in ("a", None) for y in range(3) for a in range(4)]
    df = spark.createDataFrame([(i * 24 + j, *r) for i in range(30) for j, r in enumerate(some)], SCHEMA)
    noted, fit = [], G._minimised
    monkeypatch.setattr(G, "_minimised", lambda rows, *args: noted.append(rows.count()) or fit(rows, *args))
    found = G.out_of_fold(df, ["category"], 3).collect()
    assert len(found) == 720 and noted[0] <= 24 * 25 and noted[1] <= 24 * 25 * 3


def test_numbers_of_equal_rows_weigh_as_the_rows(spark):
    some = [(j, "a", y, [float(a), float(a * y % 3), 0.1]) for j, (y, a) in enumerate((y, a) for y in range(3) for a in range(4))]
    times = lambda j: 1 + j * j % 7
    df = spark.createDataFrame([(100 * j + i, *r) for j, *r in some for i in range(times(j))], SCHEMA)
    counted = spark.createDataFrame([(*r, times(r[0])) for r in some], SCHEMA + ", n long")
    one, two = (G.fit_probes(d, ["category"], 3, n=n).first().probe for d, n in ((df, None), (counted, "n")))
    assert np.allclose(one.coef, two.coef, atol=1e-6) and np.allclose(one.scale, two.scale) and two.scale[2] == 0


def test_inner_folds_follow_from_the_numbers(rows):
    dealt = G._dealt(rows, ["category"], "id", 5, 0).withColumns({"fold": F.col("_no") % F.col("_folds"), "inners": F.expr(G._INNERS)}).collect()
    folds = {r.id: r.fold for r in G.stratified(rows, ["category"]).collect()}
    assert {r.id: r.fold for r in dealt} == folds
    for o in range(5):
        known = rows.where(~F.col("id").isin([i for i, f in folds.items() if f == o]))
        assert {r.id: r.inners[o] for r in dealt if r.inners[o] >= 0} == {r.id: r.fold for r in G.stratified(known, ["category"]).collect()}


def test_the_roundtrip_scores_equal_features_once(spark, monkeypatch):
    """what the probes score grows with the different rows, and the numbers are those of all rows."""
    from loomlens.plans import inspect_queries as Q

    sf = "/root/testdata/sf0.001"
    rows = Q._by_category(spark, sf)
    twice = rows.unionByName(rows.withColumn("id", F.col("id") + 1)).cache()
    monkeypatch.setattr(Q, "_by_category", lambda *args: twice)
    monkeypatch.setattr(Q.W, "fit_calibrated", lambda rows, by, classes: G.fit_probes(rows, by, classes))
    noted, score = [], G.probabilities
    monkeypatch.setattr(Q.W, "probabilities", lambda rows, *args: noted.append(rows.count()) or score(rows, *args))
    found = Q.probe_roundtrip(spark, sf).collect()
    assert sum(r.n for r in found) == twice.count() and all(r.same for r in found)
    assert noted == [rows.select("category", "features").distinct().count()] * 2
