"""The extraction contract: loads, batches, checks."""

from __future__ import annotations

import os

import numpy as np
import pytest

from loomlens.operators import extractors as E
from loomlens.operators import features as X


@pytest.fixture(scope="module")
def images(spark):
    r = np.random.default_rng(3)
    rows = [(i, h, 4, c, r.integers(0, 256, h * 4 * c).astype(np.uint8).tobytes()) for i, (h, c) in enumerate([(4, 3)] * 30 + [(8, 3)] * 3 + [(4, 3)] * 7)]
    return spark.createDataFrame(rows, "image_id int, height int, width int, channels int, data binary").repartition(4).cache()


def key(df):
    return sorted((r.image_id, r.row_id, r.col_id, tuple(r.feature)) for r in df.collect())


def test_equal_to_one_image_at_a_time(images):
    assert key(E.extract(images, E.statistics_extractor(2, 3))) == key(X.extract_features(images, 2))
    assert key(E.extract(images, E.statistics_extractor(2, 3), batch=1)) == key(X.extract_features(images, 2))
    assert E.extract(images.limit(0), E.statistics_extractor(2, 3)).count() == 0


def test_a_worker_loads_a_model_once_and_gets_small_batches(images, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def model(x):
            with open(log, "a") as f:
                f.write(f"batch {len(x)}\n")
            return x.mean(axis=(1, 2))[:, None, None, :]

        return model

    for _ in range(2):
        assert E.extract(images, E.Extractor(f"means {log}", ("a", "b"), 3, load)).count() == 40
    lines = open(log).read().splitlines()
    loads = [x for x in lines if x.startswith("load")]
    assert len(loads) == len(set(loads)) and max(int(x.split()[1]) for x in lines if x.startswith("batch")) <= 8
    assert sum(int(x.split()[1]) for x in lines if x.startswith("batch")) == 80


@pytest.mark.parametrize("dim, shape", [(4, None), (3, (1, 3)), (3, (2, 1, 1, 3))])
def test_a_result_that_breaks_the_declaration_is_refused(dim, shape):
    wrong = E.Extractor("wrong", ("x",), dim, lambda: None)
    found = np.zeros(shape or (1, 2, 2, 3))
    with pytest.raises(ValueError, match="wrong declares"):
        E.checked(wrong, found, 1)


def test_a_job_with_a_wrong_dimension_ends(images):
    extractor = E.Extractor("short", ("x",), 5, lambda: lambda x: np.zeros((len(x), 1, 1, 2)))
    with pytest.raises(Exception, match="short declares"):
        E.extract(images, extractor).collect()
