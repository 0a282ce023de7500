"""Packed maps against the forms with a row a cell, and the shuffles of their plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.operators import inspect as V
from loomlens.operators import localize as L
from loomlens.operators import packed as K
from loomlens.operators import rasters as P
from loomlens.operators.graph import shared_table


@pytest.fixture(scope="module")
def maps():
    r = np.random.default_rng(8)
    out = np.round(r.random((12, 10, 10)) ** 4, 3)
    out[3] = 0.5
    out[4, 2:6, 3:9] = 5.0
    return out


@pytest.fixture(scope="module")
def cells(spark, maps):
    rows = [(i, y, x, float(v)) for (i, y, x), v in np.ndenumerate(maps) if not (i == 5 and y > 7)]  # a map that lacks its last rows
    return spark.createDataFrame(rows, "image_id int, y int, x int, score double").repartition(4).cache()


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pack_and_unpack(spark, cells, maps):
    packed = K.pack(cells, 10, 10)
    found = {r.image_id: r.score for r in packed.collect()}
    assert all(found[i] == maps[i].ravel().tolist() for i in range(12) if i != 5)
    assert found[5] == maps[5].ravel().tolist()[:80] + [None] * 20
    key = lambda df: sorted(tuple(r) for r in df.select("image_id", "y", "x", "score").collect())
    assert key(K.unpack(packed, 10)) == key(cells)
    odd = spark.createDataFrame([(1, -1, 0, 1.0), (1, 0, 9, 2.0), (1, 0, 0, None)], "image_id int, y int, x int, score double")
    assert K.pack(odd, 1, 2).first().score == [None, None]
    assert K.pack(cells.limit(0), 10, 10).count() == 0


def test_weighted_maps_are_matrix_products(cells, maps):
    w = P.map_weights(10, 25, 1.5)
    found = {r.image_id: r.score for r in K.pack(cells, 10, 10).select("image_id", K.weighted("score", w).alias("score")).collect()}
    for i in range(12):
        m = maps[i].copy()
        if i == 5:
            m[8:] = 0
        assert np.allclose(found[i], (w @ m @ w.T).ravel())


def test_masks_and_boxes_equal_the_long_forms(cells):
    packed = K.pack(cells, 10, 10)
    on = packed.select("image_id", F.explode(K.adaptive_mask("score", 100)).alias("at"))
    long = L.adaptive_mask(cells)
    assert sorted((r.image_id, r.at) for r in on.collect()) == sorted((r.image_id, 10 * r.y + r.x) for r in long.collect())
    expected = sorted((r.image_id, r.y, r.x, r.w, r.h, r.area, r.score) for r in L.boxes(L.components(long, 8), 2).collect())
    rows = packed.select("image_id", K.boxes("score", 10, 10, 2.0, 2).alias("boxes")).collect()
    found = [(r.image_id, b.y, b.x, b.w, b.h, b.area, round(b.score, 4)) for r in sorted(rows) for b in r.boxes]
    assert sorted(found) == expected and expected
    assert all([(b.y, b.x) for b in r.boxes] == sorted((b.y, b.x) for b in r.boxes) for r in rows)


def test_scaled_maps_and_shares(cells):
    packed, bounds = K.pack(cells, 10, 10), (F.lit(0.1), F.lit(None).cast("double"))
    found = K.unpack(packed.withColumn("score", K.scaled("score", *bounds)), 10)
    one = cells.sparkSession.createDataFrame([(0.1, None)], "vmin double, vmax double")
    expected = {(r.image_id, r.y, r.x): r.score for r in P.normalised(cells, one).collect()}
    assert {(r.image_id, r.y, r.x): pytest.approx(r.score) for r in found.collect()} == expected
    share = {r.image_id: r.s for r in packed.select("image_id", K.share_from("score", 0.3).alias("s")).collect()}
    assert share == {r.image_id: pytest.approx(r.flood_share) for r in L.flood_share(cells, 0.3).collect()}
    assert packed.sparkSession.sql("SELECT array() AS m").select(K.share_from(F.col("m").cast("array<double>"), 0.3)).first()[0] is None


def test_frame_results_shuffle_maps_once_or_never(spark, cells):
    models = spark.createDataFrame([("a", 1.0, 0.0, 1.0)], "category string, threshold double, vmin double, vmax double")
    frames = spark.createDataFrame([(i, "ab"[i % 2], 100, 50, None) for i in range(13)], "image_id int, category string, width int, height int, ppm double")
    once = V.frame_results(frames, cells, F.broadcast(models), image_size=10, min_area=2)
    stored = shared_table(K.pack(cells, 10, 10))
    never = V.frame_results(F.broadcast(frames), stored, F.broadcast(models), image_size=10, min_area=2)
    assert exchanges(once) <= 2  # cells, and the frames that meet them
    rows = lambda df: sorted(df.drop("original_size").collect(), key=lambda r: r.image_id)
    assert rows(once) == rows(never) and once.where("num_defects > 0").count() > 0
    assert exchanges(V.boxed_maps(frames, F.broadcast(stored), F.broadcast(models), 10)) == 0


@pytest.mark.parametrize("shape, grid", [((7, 10), (3, 4)), ((8, 8), (4, 2)), ((5, 3), (5, 3)), ((2, 3), (4, 5))])
def test_masks_on_grids_of_uneven_sides(spark, shape, grid):
    m = np.random.default_rng(1).integers(0, 2, shape)
    pixels = spark.createDataFrame([(1, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(m)], "image_id int, y int, x int, gt int")
    found = {(r.gy, r.gx): r["mask"] for r in P.mask_on_grid(pixels, *shape, *grid).collect()}
    ends = lambda i, g, n: (i * n // g, -(-(i + 1) * n // g))
    for gy in range(grid[0]):
        for gx in range(grid[1]):
            (a, b), (c, d) = ends(gy, grid[0], shape[0]), ends(gx, grid[1], shape[1])
            assert found[gy, gx] == (m[a:b, c:d].mean() > 0.5)


def test_log_on_disk_grows_columns(spark, tmp_path):
    from loomlens.sources import tables as T

    path = str(tmp_path / "log")
    for rows, schema in (([(1, 0.5)], "run int, pro double"), ([(2, 0.6, "x")], "run int, pro double, note string"), ([(3,)], "run int")):
        T.append_log(spark.createDataFrame(rows, schema), path)
    found = T.read_log(spark, path)
    assert found.columns == ["run", "pro", "note", "append"]
    assert sorted((r.run, r.pro, r.note, r.append) for r in found.collect()) == [(1, 0.5, None, 1), (2, 0.6, "x", 2), (3, None, None, 3)]
