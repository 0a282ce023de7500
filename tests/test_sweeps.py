"""Sweeps record the configurations that can't run and finish the others."""

from __future__ import annotations

import numpy as np
import pytest

from loomlens.operators import sweeps as S


def test_a_bad_configuration_or_category_fails_alone(spark):
    r, rows = np.random.default_rng(2), []
    for c in ("a", "b", "nan", "odd", "untested"):
        for i in range(40):
            image, split = i // 4, "train" if i < 24 or c == "untested" else "test"
            label = int(split == "test" and image % 2)
            v = (r.normal(size=3) + 9 * label).tolist()
            if c == "nan" and i == 5:
                v[1] = float("nan")
            if c == "odd" and i == 7:
                v = v[:2]
            rows.append((c, f"{c}{i}", f"{c}-{image}", split, label, v))
    patches = spark.createDataFrame(rows, "category string, patch_id string, image_id string, split string, label int, feature array<double>")
    configs = [("one", "a", 0.5, 1), ("two", "a", 1.0, 3), ("three", "b", 0.25, 1), ("p", "nan", 0.5, 1), ("q", "odd", 0.5, 1), ("r", "untested", 0.5, 1), ("s", "zzz", 0.5, 1), ("t", "a", 1.5, 1), ("u", "b", None, 1), ("v", "b", 0.5, -1), ("w", "b", 0.5, 4), ("x", None, 0.5, 1)]
    found = {x.config_id: x for x in S.run_sweep(spark.createDataFrame(configs, "config_id string, category string, coreset_ratio double, n_neighbors int"), patches, (1, 3)).collect()}
    assert {k for k, x in found.items() if x.status == "done"} == {"one", "two", "three"} and len(found) == 12
    assert all((x.error is None) == (x.status == "done") for x in found.values())
    assert {k: found[k].error for k in "pqrsx"} == {"p": "features are null or not finite", "q": "features differ in size", "r": "nothing to test", "s": "no such category", "x": "no such category"}
    assert [(found[k].bank_size, found[k].n_train, found[k].n_test, found[k].feature_dim) for k in ("one", "two", "three")] == [(12, 6, 4, 3), (24, 6, 4, 3), (6, 6, 4, 3)]
    assert found["two"].image_auroc == 1 and found["one"].image_f1 == pytest.approx(1)


def test_extractors_and_gap(spark):
    runs = spark.createDataFrame([("carpet", "x", 0.9, 0.5), ("carpet", "y", 0.8, 0.7), ("aitex", "x", 0.5, None), ("leather", "y", 1.0, 0.9)], "category string, extractor string, auroc double, pro double")
    pair = {(r.category, r.metric): (r.first, r.second, r.gain) for r in S.compare_extractors(runs, "x", "y", ["auroc", "pro"]).collect()}
    assert pair["carpet", "auroc"] == pytest.approx((0.9, 0.8, -0.1)) and pair["aitex", "pro"] == (None, None, None)
    gap = {(r.extractor, r.metric): r.gap for r in S.benchmark_gap(runs, ["aitex"], ["auroc", "pro"]).collect()}
    assert gap["x", "auroc"] == pytest.approx(0.4) and gap["y", "auroc"] is None
