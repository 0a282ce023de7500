"""Small cases with known answers, and properties."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlens.functions import columns as C
from loomlens.operators import bank as B
from loomlens.operators import evaluate as E
from loomlens.operators import features as X
from loomlens.operators import grading as G
from loomlens.operators import localize as L
from loomlens.operators import ranking as R
from loomlens.operators import rasters as P
from loomlens.operators import splits as S
from loomlens.operators import typing_probe as Y
from loomlens.sources import images as I
from loomlens.sources import tables as T
from loomlens.streaming import frames as Z

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def raster(spark, a, image_id=0, **more):
    names = ["image_id", "y", "x", "score", *more]
    rows = [(image_id, y, x, float(a[y, x]), *[v[y, x].item() for v in more.values()]) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, names)


def curve(spark, labels, scores):
    rows = spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores, strict=True)], "label int, score double")
    return R.cumulative(R.score_counts(rows, []), [])


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


# ---- grading ----
def test_points_by_length_and_holes(spark):
    rows = [(s, h) for s in (50.0, 76.0, 100.0, 200.0, 300.0) for h in (False, None)] + [(20.0, True), (25.4, True), (40.0, True), (None, False)]
    df = spark.createDataFrame(rows, "s double, h boolean").select(C.defect_points(F.col("s"), F.col("h")).alias("p"))
    assert [r.p for r in df.collect()] == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 2, 2, 4, None]


def test_size_and_normalised_points(spark):
    one = spark.range(1)
    assert one.select(C.size_mm(F.lit(10.0), F.lit(30.0), F.lit(5.0))).first()[0] == 6
    with pytest.raises(Exception, match="pixels per mm"):
        one.select(C.size_mm(F.lit(1.0), F.lit(1.0), F.lit(0.0))).collect()
    assert one.select(C.points_per_100sqyd(F.lit(4), F.lit(1.0), F.lit(36.0)), C.points_per_100sqyd(F.lit(4), F.lit(0.0), F.lit(36.0))).first()[:] == (400, 0)


def test_rolls_with_and_without_defects(spark):
    rolls = spark.createDataFrame([("a", 914.4, 914.4), ("b", 9144.0, 914.4)], "roll_id string, length_mm double, width_mm double")
    defects = spark.createDataFrame([("a", 50.0, 1.0), ("a", 60.0, 2.0)], "roll_id string, w_px double, h_px double").withColumns({"ppm": F.lit(1.0), "is_hole": F.lit(None).cast("boolean")})
    found = {r.roll_id: r for r in G.roll_grades(rolls, G.sized(defects)).collect()}
    assert (found["a"].n_defects, found["a"].total_points, found["a"].width_in, found["a"].grade) == (2, 2, 36, "second")
    assert (found["b"].n_defects, found["b"].p100, found["b"].grade) == (0, 0, "first")


def test_rounding_before_points_can_change_them(spark):
    d = spark.createDataFrame([(228.64, 1.0, 1.0, False)], "w_px double, h_px double, ppm double, is_hole boolean")
    assert G.sized(d).first().points == 4 and G.sized(d, round_first=True).first().points == 3


def test_failed_frames_pass_and_verdicts_fall_back_on_boxes(spark):
    rows = [(1, True, False, 0, 0), (1, False, False, 0, 3), (1, False, None, 2, 4), (1, False, True, 0, 0), (1, False, None, 0, 0)]
    found = G.batch_summary(spark.createDataFrame(rows, "b int, failed boolean, is_defective boolean, num_defects int, points int"), "b").first()
    assert (found.total, found.defective, found.passed, found.points) == (5, 2, 3, 7)


def test_main_defect_takes_the_first_on_ties(spark):
    rows = spark.createDataFrame([(1, 5, 0, 1), (1, 9, 1, 2), (1, 9, 2, 4)], "frame int, area int, ord int, points int")
    found = G.main_defect(rows, "frame").first()
    assert found.box.ord == 1 and found.frame_points == 7


# ---- ranking ----
def test_perfect_separation(spark):
    c = curve(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert R.auroc_ap(c, []).first()[:] == (1, 1)
    best = R.best_f1(c, []).first()
    assert best.f1 == pytest.approx(1) and 0.2 < best.threshold <= 0.8
    assert R.youden_threshold(R.roc_curve(c, []), []).first().threshold == 0.8
    assert R.target_fpr_threshold(R.roc_curve(c, []), [], 0.0).first().threshold == 0.8


def test_one_class_is_null(spark):
    c = curve(spark, [0] * 5, [0.1, 0.2, 0.3, 0.4, 0.5])
    assert R.auroc_ap(c, []).first()[:] == (None, None) and R.best_f1(c, []).first().f1 is None and R.roc_curve(c, []).count() == 0


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-5, 5)), min_size=2, max_size=30))
def test_auroc_by_pairs_and_monotone_maps(spark, rows):
    y, s = zip(*rows, strict=True)
    pos, neg = [b for a, b in rows if a], [b for a, b in rows if not a]
    found, mapped = R.auroc_ap(curve(spark, y, s), []).first(), R.auroc_ap(curve(spark, y, [math.exp(v) for v in s]), []).first()
    if pos and neg:
        pairs = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert found.auroc == pytest.approx(pairs) and mapped.auroc == pytest.approx(pairs) and mapped.ap == pytest.approx(found.ap)
    else:
        assert found.auroc is None


def test_prefix_sums_over_ranges(spark):
    r = np.random.default_rng(0)
    y, s = r.integers(0, 2, 500), r.normal(size=500).round(2)
    for x in curve(spark, y, s).collect():
        assert (x.tp, x.fp) == (int(((s >= x.score) & (y == 1)).sum()), int(((s >= x.score) & (y == 0)).sum()))


def test_strictness_at_the_cut(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.6, 1)], "category string, score double, label int")
    cut = spark.createDataFrame([("a", 0.5)], "category string, threshold double")
    assert R.accuracy_at(rows, cut, ["category"]).first().accuracy == 0.5


def test_bounds_exact_and_approximate(spark):
    rows = spark.range(0, 10001).select(F.col("id").cast("double").alias("score"))
    assert R.map_bounds(rows, []).first()[:] == (100, 9900)
    low, high = R.approx_map_bounds(rows, []).first()
    assert abs(low - 100) <= 2 and abs(high - 9900) <= 2


# ---- classifier metrics ----
def proba(spark, rows):
    return spark.createDataFrame(rows, "y int, proba array<double>")


def test_calibration_and_coverage(spark):
    assert E.calibration_error(proba(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])).first().ece == 0
    assert E.calibration_error(proba(spark, [(1, [0.9, 0.1])] * 4)).first().ece > 0.5
    found = {r.threshold: r for r in E.coverage_accuracy(proba(spark, [(0, [0.9, 0.1])] * 3 + [(1, [0.55, 0.45])])).collect()}
    assert found[0.6].coverage == 0.75 and found[0.6].selective_accuracy == 1 and found[0.0].n_predicted == 4
    assert len(found) == 10


def test_an_edge_belongs_to_the_lower_bin(spark):
    rows = proba(spark, [(0, [0.6, 0.4]), (1, [0.55, 0.45])])  # one bin: accuracy 0.5, confidence 0.575
    assert E.calibration_error(rows).first().ece == pytest.approx(0.075)


def test_report_has_zeros_where_undefined(spark):
    rows = proba(spark, [(0, [0.9, 0.1, 0.0]), (1, [0.9, 0.1, 0.0])])
    found = {r.label: r for r in E.classification_report(rows, 3).collect()}
    assert found["0"].precision == 0.5 and found["2"].f1 == 0 and found["accuracy"].f1 == 0.5 and found["macro"].recall == pytest.approx(1 / 3)
    matrix = {r.y: r for r in E.confusion_matrix(rows, 3).collect()}
    assert matrix[1].n_0 == 1 and matrix[2].recall == 0


# ---- rasters ----
def test_normalise_clips_and_uses_bounds(spark):
    a = {(r.y, r.x): r.score for r in P.normalised(raster(spark, np.array([[0, 5], [10, 2.5]]))).collect()}
    assert a[0, 0] == 0 and a[1, 0] == pytest.approx(1)
    bounds = spark.createDataFrame([(0.0, 1.0)], "vmin double, vmax double")
    assert sorted(r.score for r in P.normalised(raster(spark, np.array([[-1.0, 2.0]])), bounds).collect()) == [0, 1]


@few
@given(st.integers(1, 20), st.integers(1, 40))
def test_resampling_weights_sum_to_one(n, m):
    assert np.allclose(P.bilinear_weights(n, m).sum(axis=1), 1)


def test_smoothing_attenuates_borders_only():
    sums = P.gaussian_weights(60, 4.0).sum(axis=1)
    assert sums[30] == pytest.approx(1) and sums[0] < 0.7


def test_fused_resample_and_smooth_equal_two_steps(spark):
    a = raster(spark, np.random.default_rng(1).random((4, 4)))
    once, twice = P.resampled(a, 4, 12, sigma=1.0), P.smoothed(P.resampled(a, 4, 12), 12, 1.0)
    x, y = ({(r.y, r.x): r.score for r in d.collect()} for d in (once, twice))
    assert len(x) == 144 and all(x[k] == pytest.approx(y[k]) for k in y)


def test_local_mean_counts_padding(spark):
    rows = spark.createDataFrame([(0, 0, y, x, 1.0) for y in range(3) for x in range(3)], "image_id int, channel int, y int, x int, value double")
    found = {(r.y, r.x): r.value for r in P.local_mean(rows, 3, 3).collect()}
    assert found[1, 1] == 1 and found[0, 0] == pytest.approx(4 / 9) and found[0, 1] == pytest.approx(6 / 9)


# ---- localization ----
def test_a_square_gives_its_box(spark):
    a = np.zeros((32, 32))
    a[10:20, 12:22] = 1
    found = L.boxes(L.components(L.fixed_mask(raster(spark, a)), 8)).collect()
    assert [(b.x, b.y, b.w, b.h, b.area, b.score) for b in found] == [(12, 10, 10, 10, 100, 1.0)]


def test_adaptive_isolates_what_a_fixed_cut_floods(spark):
    a = np.full((32, 32), 0.6)
    a[4:8, 4:8] = 1.0
    cells = raster(spark, a)
    assert L.fixed_mask(cells).count() > 900
    (box,) = L.boxes(L.components(L.adaptive_mask(cells), 8), 1).collect()
    assert box.w <= 8 and box.h <= 8
    assert L.adaptive_mask(raster(spark, np.full((8, 8), 0.3))).count() == 0
    single = np.zeros((8, 8))
    single[3, 3] = 1
    assert L.boxes(L.components(L.fixed_mask(raster(spark, single)), 8)).count() == 0


def test_component_joins_send_nothing_through_the_driver(spark):
    """labels go by shuffles, however small they look."""
    cells = raster(spark, np.eye(8)).where("score > 0")
    plan = L.components_by_runs(cells, 8)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


@few
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=2, max_size=7), st.sampled_from([4, 8]))
def test_components_two_ways_and_by_flood(spark, rows, connectivity):
    a = np.array(rows)
    cells = raster(spark, a).where("score > 0")
    found = {(r.y, r.x): r.comp for r in L.components(cells, connectivity).collect()}
    assert found == {(r.y, r.x): r.comp for r in L.components_by_runs(cells, connectivity).collect()}
    for start in map(tuple, np.argwhere(a)):
        seen, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p = (y + dy, x + dx)
                    if (connectivity == 8 or not (dy and dx)) and p not in seen and 0 <= p[0] < a.shape[0] and 0 <= p[1] < 7 and a[p]:
                        seen.add(p)
                        todo.append(p)
        assert found[start] == min(seen)[0] * (1 << 31) + min(seen)[1]


def test_box_coverage(spark):
    box = spark.createDataFrame([(0, 0, 0, 2, 3), (0, 1, 1, 1, 1)], "image_id long, x long, y long, w long, h long")
    assert L.covered(box).count() == 6 and L.covered(box.limit(0)).count() == 0
    cells = {(r.gy, r.gx) for r in L.grid_cells(box.limit(1), 16, 4, 4).collect()}
    assert cells == {(0, 0)}


def test_size_bins_put_edges_above(spark):
    areas = spark.createDataFrame([(x,) for x in (50, 100, 299, 300, 9999)], "area int")
    assert [r.bin for r in L.size_bins(areas, 100, 300).orderBy("area").collect()] == ["small", "medium", "medium", "large", "large"]


def test_overlap_score(spark):
    gt = np.zeros((16, 16), int)
    gt[4:8, 4:8] = 1
    cells = raster(spark, gt.astype(float), gt=gt)
    regions = L.components(cells.where("gt = 1"), 4)
    assert L.overlap_score(cells, regions).first().pro == pytest.approx(1, abs=0.01)
    assert L.overlap_score(cells.withColumn("gt", F.lit(0)), regions.limit(0)).first().pro is None


@few
@given(st.integers(0, 10**6))
def test_overlap_score_equals_one_scan_per_threshold(spark, seed):
    r = np.random.default_rng(seed)
    score, gt = r.random((9, 9)).round(2), (r.random((9, 9)) < 0.3).astype(int)
    gt[0, 0] = 1
    cells = raster(spark, score, gt=gt)
    regions = L.components(cells.where("gt = 1"), 4)
    labels = {(x.y, x.x): x.comp for x in regions.collect()}
    points = []
    for t in np.linspace(score.min(), score.max(), 200):
        on = score >= t
        by = {}
        for (y, x), c in labels.items():
            by.setdefault(c, []).append(on[y, x])
        points.append((on[gt == 0].sum() / ((gt == 0).sum() + 1e-8), float(np.mean([np.sum(v) / (len(v) + 1e-8) for v in by.values()]))))
    points.sort()
    x, y = np.array(points).T
    keep = x < 0.3
    xs, ys = np.concatenate([[0], x[keep], [0.3]]), np.concatenate([[y[0]], y[keep], [np.interp(0.3, x, y)]])
    assert L.overlap_score(cells, regions).first().pro == pytest.approx(np.trapezoid(ys, xs) / 0.3, abs=2e-2)


# ---- banks ----
def patch_rows(spark, features, category="a"):
    return spark.createDataFrame([(category, i, f.astype(float).tolist()) for i, f in enumerate(features)], "category string, patch_id long, feature array<float>")


def test_coreset_counts_order_and_determinism(spark):
    rows = patch_rows(spark, np.random.default_rng(0).normal(size=(200, 16)))
    first, again = ([(r.rank, r.patch_id) for r in B.coreset(rows.repartition(n), ratio=0.1).orderBy("rank").collect()] for n in (1, 5))
    assert len({p for _, p in first}) == 20 and first == again
    assert B.coreset(rows, keep=500).count() == 200
    assert B.coreset_distributed(rows, keep=12).select("patch_id").distinct().count() == 12


def test_distributed_radius_is_within_four_times_the_bound(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    rows = patch_rows(spark, x)
    radius = lambda ids: np.sqrt(((x[:, None] - x[ids][None]) ** 2).sum(-1)).min(1).max()
    exact, far = (radius([r.patch_id for r in d.collect()]) for d in (B.coreset(rows, keep=10), B.coreset_distributed(rows, keep=10)))
    assert far <= 4 * exact  # the greedy radius is at most twice the optimum, and at least it


def test_radius_falls_as_the_bank_grows():
    x = np.random.default_rng(1).normal(size=(100, 8))
    radii = [B.greedy_centers(x, k, 0)[1].max() for k in (1, 5, 20, 100)]
    assert radii == sorted(radii, reverse=True) and radii[-1] == 0


def test_bank_statistics(spark):
    x = np.random.default_rng(4).normal(size=(60, 6))
    rows = patch_rows(spark, x).withColumns({"label": F.lit(0), "split": F.lit("train")})
    found = {r.ratio: r for r in B.bank_statistics(rows, [0.05, 0.5, 1.0]).collect()}
    ids = [r.patch_id for r in B.coreset(rows, ratio=0.05).collect()]
    x32 = x.astype(np.float32).astype(float)
    assert found[0.05].radius == pytest.approx(np.sqrt(((x32[:, None] - x32[ids][None]) ** 2).sum(-1)).min(1).max(), abs=1e-5)
    assert found[1.0].radius == pytest.approx(0, abs=1e-6) and found[0.5].n_keep == 30 and found[0.05].kept_share == pytest.approx(0.05)


@pytest.mark.parametrize("rows", [7, 4096])
def test_neighbours_in_blocks_and_pieces(spark, rows):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(90, 4)).astype(np.float32).astype(float), r.normal(size=(120, 4)).astype(np.float32).astype(float)
    q, b = patch_rows(spark, x), patch_rows(spark, y)
    alone = q.limit(1).withColumn("category", F.lit("no bank"))
    found = B.knn_distances(q.unionByName(alone), b, (1, 3), rows=rows)
    seen = {(i.category, i.patch_id): (i.d1, i.d3) for i in found.collect()}
    d = np.sort(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), axis=1)
    own = {i: v for (c, i), v in seen.items() if c != "no bank"}
    assert len(own) == 90 and all(own[i] == pytest.approx((d[i, 0], d[i, :3].mean())) for i in own)
    assert [v for (c, _), v in seen.items() if c == "no bank"] == [(None, None)]


def test_distributed_coreset_keeps_a_ratio(spark):
    a, b = (patch_rows(spark, np.random.default_rng(i).normal(size=(n, 4))).withColumn("category", F.lit(c)) for i, n, c in ((0, 230, "a"), (1, 7, "b")))
    found = B.coreset_distributed(a.unionByName(b), ratio=0.1)
    assert {r.category: (r["count"], r.n) for r in found.groupBy("category").agg(F.count("*").alias("count"), F.countDistinct("patch_id").alias("n")).collect()} == {"a": (23, 23), "b": (1, 1)}


def test_coreset_queries_keep_a_share(spark):
    from loomlens.plans import score_queries as Q

    sf = "/root/testdata/sf0.001"
    normal = [r for r in B.normal_patches(Q._patches(spark, sf)).collect()]
    greedy = {(r.category, r["rank"]): r.patch_id for r in Q.coreset_greedy_share(spark, sf).collect()}
    far = Q.coreset_distributed(spark, sf).groupBy("category").agg(F.countDistinct("patch_id").alias("n")).collect()
    for c in {r.category for r in normal}:
        rows = sorted((r for r in normal if r.category == c), key=lambda r: r.patch_id)
        x = np.array([r.feature for r in rows])
        first = min(range(len(rows)), key=lambda i: hashlib.md5(f"0|{rows[i].patch_id}".encode()).hexdigest())
        keep = max(1, len(rows) // 10)
        chosen = [first]
        while len(chosen) < keep:
            chosen.append(int(np.min([((x - x[i]) ** 2).sum(1) for i in chosen], axis=0).argmax()))
        assert [greedy[c, i] for i in range(keep)] == [rows[i].patch_id for i in chosen] and (c, keep) not in greedy
        assert [r.n for r in far if r.category == c] == [keep]


def test_approximate_neighbours_recall(spark):
    r = np.random.default_rng(2)
    bank, near = r.normal(size=(150, 8)), None
    near = bank[:60] + r.normal(size=(60, 8)) * 0.05
    q, b = patch_rows(spark, near), patch_rows(spark, bank)
    exact = {x.patch_id: x.d1 for x in B.knn_distances(q, b).collect()}
    close = {x.patch_id: x.d1 for x in B.knn_approximate(q, b).collect()}
    truth = np.sqrt(((near[:, None] - bank[None]) ** 2).sum(-1)).min(1)
    assert all(exact[i] == pytest.approx(truth[i], abs=1e-5) for i in range(60))
    assert np.mean([abs(close.get(i, 9) - exact[i]) < 1e-5 for i in exact]) >= 0.9


# ---- features ----
def test_tokens_in_row_order_and_mismatch(spark):
    rows = spark.createDataFrame([(0, [[float(i)] for i in range(12)])], "image_id int, tokens array<array<double>>")
    assert {(r.row_id, r.col_id): r.token[0] for r in X.tokens_to_grid(rows, 3, 4).collect()} == {(i // 4, i % 4): i for i in range(12)}
    with pytest.raises(Exception, match="token count"):
        X.tokens_to_grid(rows, 3, 5).collect()
    flat = rows.select("image_id", F.posexplode("tokens").alias("pos", "token"))
    assert X.patch_tokens(flat, 2, 5).where("i = 0").first().token == [2.0]
    with pytest.raises(Exception, match="fewer tokens"):
        X.patch_tokens(flat, 4, 4).collect()


def test_pooling_falls_back_on_all_cells(spark):
    rows = [(i, 0, float(v), m) for i in (0, 1, 2) for v, m in ((1, i == 0), (3, False if i < 2 else None))]
    found = {r.image_id: r.value for r in X.pooled(spark.createDataFrame(rows, "image_id int, channel int, value double, mask boolean")).collect()}
    assert found == {0: 1, 1: 2, 2: 2}


def test_features_that_are_not_finite_are_reported(spark):
    rows = spark.createDataFrame([("a", 0, 0, [1.0, 2.0]), ("a", 1, 1, [float("nan"), 1.0])], "category string, row_id int, col_id int, feature array<double>")
    assert {r.check: r.ok for r in X.feature_checks(rows, 2).collect()} == {"grid": True, "dimension": True, "finite": False, "not_empty": True}


# ---- splits ----
def strips(spark, n):
    rows = [(1, s, 4096, 256) for s in range(n)]
    tiles = S.tiles(spark.createDataFrame(rows, "roll long, strip long, width_px long, height_px long"))
    return tiles.withColumn("name", S.tile_name(F.col("roll"), F.col("strip"), F.col("tile_idx"))).withColumn("grp", S.group_of(F.col("name")))


def test_a_strip_has_sixteen_tiles_and_no_partial_one(spark):
    assert sorted(r.tile_idx for r in strips(spark, 1).collect()) == list(range(16))
    assert S.tiles(spark.createDataFrame([(200, 256), (300, 256)], "width_px long, height_px long")).count() == 1


def test_groups_stay_whole_and_targets_stop_the_deal(spark):
    dealt = S.split_by_group(strips(spark, 10), "grp", 48, 32).collect()
    n = {s: sum(r.n for r in dealt if r.split == s) for s in ("train", "test")}
    assert n["train"] >= 48 and n["test"] >= 32 and all(v % 16 == 0 for v in n.values())
    many = S.split_by_group(strips(spark, 100), "grp", 16, 16)
    assert sorted((r.split, r.n) for r in many.collect()) == [("test", 16), ("train", 16)]
    assert S.leakage(many, "grp").first().leak_share == 0


@few
@given(st.integers(0, 50), st.integers(1, 90), st.integers(1, 90))
def test_no_group_is_in_both_splits(spark, seed, n_train, n_test):
    dealt = S.split_by_group(strips(spark, 6), "grp", n_train, n_test, seed).collect()
    assert len({r.grp for r in dealt}) == len(dealt)


def test_category_choice(spark):
    catalog = S.catalog_columns(spark.createDataFrame([("/d/b/train/good/1.png",), ("/d/a/train/good/2.png",), ("/d/c/test/hole/3.png",)], "path string"))
    names = lambda d: [r.category for r in d.collect()]
    assert names(S.select_categories(catalog, "all")) == ["a", "b"] and names(S.select_categories(catalog)) == ["carpet", "leather", "grid"]
    assert names(S.select_categories(catalog, "x")) == ["x"]
    with pytest.raises(ValueError, match="no category"):
        S.select_categories(catalog.where("false"), "all")


def test_an_image_that_lacks_tokens_keeps_those_it_has(spark):
    """16 rows give an image of ten tokens and one of six, as in tables whose size isn't a multiple of ten."""
    tokens = spark.range(16).selectExpr("id div 10 AS image_id", "id % 10 AS pos", "array(id) AS token")
    found = {(r.image_id, r.row_id, r.col_id): r.token[0] for r in X.patch_tokens(tokens, 3, 3, prefix=1).collect()}
    assert found == {(n // 10, (n % 10 - 1) // 3, (n % 10 - 1) % 3): n for n in range(16) if n % 10}
    with pytest.raises(Exception, match="more tokens"):
        X.patch_tokens(tokens, 2, 3, prefix=1).collect()


def test_a_split_by_tile_numbers_only_ranges_that_it_reaches(spark, monkeypatch):
    """F8, F10: of 20,000 keys those of a few ranges are shuffled, and the split is that of the whole order."""
    from loomlens.operators import splits as S

    noted, number = [], S.hash_numbered
    monkeypatch.setattr(S, "hash_numbered", lambda rows, *args: noted.append(rows.count()) or number(rows, *args))
    found = {r.name: r.split for r in S.split_by_tile(spark.range(20_000).select(F.col("id").cast("string").alias("name")), "name", 30, 9).collect()}
    order = sorted(map(str, range(20_000)), key=lambda k: hashlib.md5(f"0|{k}".encode()).hexdigest())
    assert found == {k: "train" if i < 30 else "test" for i, k in enumerate(order[:39])} and noted[0] < 100


# ---- typing ----
def blobs(n, seed=0):
    r = np.random.default_rng(seed)
    return [(i, i % 2, (r.normal(size=8) * 0.5 + (3 if i % 2 else -3)).tolist()) for i in range(n)]


def test_probe_separates_abstains_and_persists(spark, tmp_path):
    rows = spark.createDataFrame(blobs(60), "id int, y int, features array<double>")
    model = Y.train_probe(rows, max_iter=50)
    kind, conf = Y.predicted_type(F.col("proba"), ["hole", "stain"])
    found = Y.probabilities(model, rows).select("y", kind.alias("kind"), conf.alias("conf")).collect()
    assert all(r.kind == ("stain" if r.y else "hole") and r.conf > 0.8 for r in found)
    middle = spark.createDataFrame([(0, 0, [0.01] * 8)], "id int, y int, features array<double>")
    assert Y.probabilities(model, middle).select(Y.predicted_type(F.col("proba"), ["hole", "stain"], 0.99)[0]).first()[0] == "unknown"
    model.save(str(tmp_path / "probe"))
    again = type(model).load(str(tmp_path / "probe"))
    assert Y.probabilities(again, middle).first().proba == Y.probabilities(model, middle).first().proba


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_out_of_fold_and_calibrated_probabilities(spark, method):
    rows = E.stratified_folds(spark.createDataFrame(blobs(40), "id int, y int, features array<double>"), "id", "y", most=2)
    scored = Y.calibrated(Y.out_of_fold(rows, 2, max_iter=20), 2, method).collect()
    assert len(scored) == 40 and all(abs(sum(r.proba) - 1) < 1e-9 for r in scored)
    assert np.mean([np.argmax(r.proba) == r.y for r in scored]) > 0.95


def test_folds_need_two_rows_of_each_class(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "id int, c string")
    assert E.stratified_folds(rows, "id", "c").count() == 0


# ---- sources and sinks ----
def test_folder_catalog_and_pixels(spark, tmp_path):
    a = np.arange(4 * 4 * 3).reshape(4, 4, 3)
    for p in ("carpet/train/good/000.png", "carpet/test/good/001.png", "carpet/test/hole/002.png"):
        png(tmp_path / p, a)
    found = I.image_catalog(spark, str(tmp_path))
    assert sorted((r.split, r.defect_type, r.stem, r.label) for r in found.collect()) == [("test", "good", "001", 0), ("test", "hole", "002", 1), ("train", "good", "000", 0)]
    with pytest.raises(FileNotFoundError):
        I.image_catalog(spark, str(tmp_path / "carpet" / "train"), "test")
    images = I.load_images(spark, str(tmp_path / "carpet" / "train"))
    assert {(r.y, r.x, r.channel): r.value for r in I.pixel_rows(images).collect()} == {(y, x, c): float(a[y, x, c]) for y in range(4) for x in range(4) for c in range(3)}
    features = X.extract_features(images, 2).collect()
    assert len(features) == 4 and len(features[0].feature) == 12


def test_features_are_of_whole_pages(spark, tmp_path):
    from loomlens.plans import score_queries

    head = "<!doctype html><html><head><meta charset='utf-8'><title>A page</title>"
    texts = [head + "a" * 700, head + "z" * 701, head + "é" * 5, "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {(r.image_id, r.row_id, r.col_id): r.feature for r in score_queries.extract_features(spark, str(tmp_path)).collect()}
    assert len(found) == 4 * len(texts) and found[0, 1, 1] != found[1, 1, 1]
    for i, text in enumerate(texts):
        data = (text or "").encode()
        data += bytes(-len(data) % 16 if data else 16)
        for k, expected in enumerate(X.patch_statistics(np.frombuffer(data, np.uint8).reshape(-1, 8, 1).astype(float), 2)):
            assert found[i, k // 2, k % 2] == pytest.approx(expected.tolist(), abs=1e-4)


def test_queries_on_whole_features(spark):
    from loomlens.plans import score_queries as Q

    for name, parts in (("local_aggregate", 64), ("pool_features", 64), ("concat_mixed_grids", 128), ("standardize", 64)):
        assert Q.QUERIES[f"{name}_whole"](spark, "/root/testdata/sf0.001").select("channel").distinct().count() == parts
    assert [r.dim for r in Q.concat_layers_whole(spark, "/root/testdata/sf0.001").select("dim").distinct().collect()] == [64]


def test_models_round_trip(spark, tmp_path):
    bank = patch_rows(spark, np.random.default_rng(0).normal(size=(50, 8)))
    models = spark.createDataFrame([("a", 0.2, 1.23, 0.1, 0.9), ("b", None, None, None, None)], "category string, coreset_ratio double, threshold double, vmin double, vmax double")
    T.save_models(models, bank, str(tmp_path))
    kept, vectors = T.load_models(spark, str(tmp_path))
    found = {r.category: r for r in kept.collect()}
    assert found["a"].threshold == 1.23 and found["b"].threshold is None and found["b"].coreset_ratio == 0.1
    assert sorted(tuple(r.feature) for r in vectors.collect()) == sorted(tuple(r.feature) for r in bank.collect())


def test_log_grows_columns(spark):
    log = T.append_results(spark.createDataFrame([("a", 1)], "run string, x int"), spark.createDataFrame([("b", 2)], "run string, extra int"))
    assert log.columns == ["run", "x", "extra"] and {tuple(r) for r in log.collect()} == {("a", 1, None), ("b", None, 2)}


def test_defects_to_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, 2.0, 1, 3, 4, 5, 6)], "pos_mm double, size_mm double, points int, x int, y int, w int, h int")
    T.write_defects(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out")).first()[:] == rows.first()[:]


# ---- streams ----
def test_late_frames_are_dropped_in_append_mode(spark, tmp_path):
    schema = "frame_id long, ts timestamp, roll_id long, num_defects int"
    frame = lambda i, day: spark.sql(f"SELECT {i}L AS frame_id, timestamp'2024-01-{day:02d} 12:00:00' AS ts, 1L AS roll_id, 1 AS num_defects")
    source = str(tmp_path / "in")
    for i, day in enumerate((1, 2, 8, 9, 1, 20)):
        frame(i, day).coalesce(1).write.mode("append").parquet(source)
    stream = Z.windowed_grades(Z.frame_stream(spark, source, schema, files_per_trigger=1))
    found = {r.day: r.n_frames for r in Z.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    assert found.get("2024-01-02") == 1 and found.get("2024-01-01") == 1 and "2024-01-20" not in found


def test_repeated_frames_count_once(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS frame_id, timestamp'2024-01-01 00:00:00' AS ts, 1L AS b, false AS failed, true AS is_defective, 1 AS num_defects, 2 AS points FROM range(6)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = Z.running_summary(Z.frame_stream(spark, str(tmp_path / "in"), rows.schema), "b", delay="1 day")
    found = Z.run_to_table(stream, "once", "complete", str(tmp_path / "state")).first()
    assert (found.total, found.points) == (3, 6)


def repeated(spark, times=20):
    """30 different rows, each as often as `times`."""
    return spark.createDataFrame([(i * 30 + j, y, [float(j // 3), float(j * y % 4)]) for i in range(times) for j, y in ((j, j % 3) for j in range(30))], "id int, y int, features array<double>")


def test_equal_rows_are_fitted_once_by_a_single_probe(spark, monkeypatch):
    """the fit sees different rows only, and no join sends all rows of a class to a task."""
    noted = []

    class Noting(Y.LogisticRegression):
        def fit(self, rows):
            noted.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(Y, "LogisticRegression", Noting)
    rows = repeated(spark)
    assert len(Y.probabilities(Y.train_probe(rows), rows).collect()) == 600 and noted == [30]


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_counted_rows_are_calibrated_as_the_rows(spark, method):
    """a row that stands for n equal ones counts as those."""
    rows = repeated(spark).selectExpr("id", "y", "transform(array(1.0D, features[0] + 1, features[1] + y + 1), x -> x / (features[0] + features[1] + y + 3)) AS proba", "id % 2 AS fold")
    counted = rows.groupBy("y", "proba", "fold").agg(F.count("*").alias("n"))
    one = {(r.y, r.fold, tuple(r.proba)) for r in Y.calibrated(rows, 3, method).select("y", "fold", F.transform("proba", lambda p: F.round(p, 6)).alias("proba")).collect()}
    two = {(r.y, r.fold, tuple(r.proba)) for r in Y.calibrated(counted, 3, method, "n").select("y", "fold", F.transform("proba", lambda p: F.round(p, 6)).alias("proba")).collect()}
    assert one == two and E.calibration_error(rows).first().ece == pytest.approx(E.calibration_error(counted, n="n").first().ece)


# ---- at scale ----
def test_running_sums_of_piled_up_scores_are_even(spark):
    """Nearly all distinct scores at the low end: ranges still hold like numbers of rows, and the sums are right."""
    r = np.random.default_rng(1)
    x = np.unique(np.concatenate([r.random(4000) * 1e-6, [1.0, 50.0, 1e9]]))
    rows = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(x)], "score double, n int").repartition(4)
    ranged = rows.repartitionByRange(F.asc("score")).groupBy(F.spark_partition_id()).count().collect()
    found = {q.score: (q.n_upto, q.n_all) for q in R.running_sums(rows, [], "score", ["n"]).collect()}
    upto = np.cumsum([i % 3 for i in range(len(x))])
    assert found == {float(v): (int(u), int(upto[-1])) for v, u in zip(x, upto, strict=True)}
    sizes = sorted(q["count"] for q in ranged)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_exact_percentiles(spark):
    r = np.random.default_rng(2)
    values = {g: r.integers(0, 40, n).astype(float) for g, n in (("a", 1), ("b", 2), ("c", 997))}
    rows = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [("c", None)], "g string, score double")
    found = {q.g: (q.q0, q.q1, q.q2) for q in R.exact_percentiles(rows, ["g"], (0.01, 0.5, 0.99)).collect()}
    for g, x in values.items():
        assert found[g] == pytest.approx(np.percentile(x, [1, 50, 99]))


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_of_random_rasters(diagonal):
    r = np.random.default_rng(int(diagonal))
    for _ in range(60):
        on = r.random((int(r.integers(1, 14)), int(r.integers(1, 14)))) < r.random()
        cells = [tuple(c) for c in np.argwhere(on)]
        seen, first = {}, {}
        for c in cells:
            if c in seen:
                continue
            todo, seen[c] = [c], c
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        n = (y + dy, x + dx)
                        if (diagonal or abs(dy) + abs(dx) == 1) and n not in seen and 0 <= n[0] < on.shape[0] and 0 <= n[1] < on.shape[1] and on[n]:
                            seen[n] = c
                            todo.append(n)
        first = {c: i for i, c in enumerate(cells)}
        y, x = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
        assert L._label(y, x, diagonal).tolist() == [first[seen[c]] for c in cells]


def test_calibration_never_sees_its_own_rows(spark, monkeypatch):
    """Inner folds: calibrators get rows that their probe wasn't fitted on; outer folds: neither sees the asked rows."""
    rows = E.stratified_folds(spark.createDataFrame(blobs(36), "id int, y int, features array<double>"), "id", "y", most=2)
    fitted, judged = [], []
    train, calibrate = Y.train_probe, Y.fit_calibrators
    ids = lambda df: {r.id for r in df.select("id").collect()}

    def train_and_note(known, **options):
        fitted.append(ids(known))
        return train(known, max_iter=10)

    def calibrate_and_note(known, *options):
        judged.append(ids(known))
        return calibrate(known, *options)

    monkeypatch.setattr(Y, "train_probe", train_and_note)
    monkeypatch.setattr(Y, "fit_calibrators", calibrate_and_note)
    scored = Y.out_of_fold(rows, 2, classes=2, method="sigmoid").collect()
    assert len(fitted) == len(judged) == 2 * 5 and len(scored) == 36
    folds = {k: {r.id for r in scored if r.fold == k} for k in (0, 1)}
    for i, (a, b) in enumerate(zip(fitted, judged, strict=True)):
        assert not a & b and not (a | b) & folds[i // 5] and a | b == folds[1 - i // 5]
    assert np.mean([np.argmax(r.proba) == r.y for r in scored]) > 0.95


def test_distributed_coreset_in_many_rounds(spark):
    x = np.random.default_rng(5).normal(size=(400, 3))
    rows = patch_rows(spark, x)
    found = [r.patch_id for r in B.coreset_distributed(rows, keep=6, rows=30).collect()]
    radius = lambda chosen: np.sqrt(((x[:, None] - x[chosen][None]) ** 2).sum(-1)).min(1).max()
    exact = [r.patch_id for r in B.coreset(rows, keep=6).collect()]
    assert len(set(found)) == 6 and radius(found) <= 4 * radius(exact)


def test_images_are_resized_grey_ones_too_and_broken_ones_kept_apart(spark, tmp_path):
    png(tmp_path / "a.png", np.full((4, 6, 3), 77))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    found = I.load_images(spark, str(tmp_path), size=2).collect()
    assert [(r.height, r.width, r.channels, set(r.data)) for r in found] == [(2, 2, 3, {77})]
    bad = I.quarantined_images(spark, str(tmp_path)).collect()
    assert [(r.image_id.rsplit("/", 1)[-1], r.reason) for r in bad] == [("b.png", "not decodable")]
    grey = I._rgb(bytes([5, 6]), 1, 2, 1)
    assert grey.tolist() == [[[5, 5, 5], [6, 6, 6]]] and I._rgb(bytes([1, 2, 3, 9]), 1, 1, 4).tolist() == [[[3, 2, 1]]]
    ramp = I.resized(np.arange(16, dtype=np.uint8).reshape(1, 16, 1).repeat(3, axis=2), 4)
    assert ramp.shape == (4, 4, 3) and (np.diff(ramp[0, :, 0].astype(int)) > 0).all()


def test_approximate_neighbours_answer_every_query(spark):
    r = np.random.default_rng(3)
    bank, far = r.normal(size=(40, 6)), r.normal(size=(10, 6)) + 40
    q, b = patch_rows(spark, far), patch_rows(spark, bank)
    close = {x.patch_id: x.d1 for x in B.knn_approximate(q, b).collect()}
    truth = np.sqrt(((far[:, None] - bank[None]) ** 2).sum(-1)).min(1)
    assert len(close) == 10 and all(0.999 * truth[i] <= close[i] <= 1.2 * truth[i] for i in close)


def test_map_checks(spark):
    good = [(1, y, x, float(y + x)) for y in range(3) for x in range(3)]
    bad = [(2, y, x, float("nan") if y == x == 0 else 1.0) for y in range(3) for x in range(2)]
    twice = [(3, 0, 0, 1.0)] * 9
    cells = spark.createDataFrame(good + bad + twice, "image_id int, y int, x int, score double")
    scores = spark.createDataFrame([(1, 4.0), (3, 2.0)], "image_id int, score double")
    found = {(r.image_id, r.check): r.ok for r in X.map_checks(cells, scores, 3).collect()}
    assert found == {(1, "size"): True, (1, "finite"): True, (1, "score"): True, (2, "size"): False, (2, "finite"): False, (2, "score"): False, (3, "size"): False, (3, "finite"): True, (3, "score"): False}


def test_frame_results_of_one_frame(spark):
    """A hot square, found, sized, typed and put onto the original picture; a frame without a map; one of an unknown category."""
    from loomlens.operators import inspect as V

    cells = [(1, y, x, 90.0 if 4 <= y < 8 and 2 <= x < 6 else 1.0 + (x + y) % 2 * 0.01) for y in range(16) for x in range(16)]
    cells = spark.createDataFrame(cells + [(3, y, x, 1.0) for y in range(16) for x in range(16)], "image_id int, y int, x int, score double")
    frames = spark.createDataFrame([(1, "a", 160, 320, 0.05), (2, "a", 16, 16, None), (3, "z", 16, 16, -1.0)], "image_id int, category string, width int, height int, ppm double")
    models = spark.createDataFrame([("a", 50.0, 0.0, 100.0)], "category string, threshold double, vmin double, vmax double")
    features = spark.createDataFrame([(1, r, c, [float(r == 1 and c < 2)] * 4) for r in range(4) for c in range(4)], "image_id int, row_id long, col_id long, feature array<double>")
    probe = Y.train_probe(spark.createDataFrame([(i, i % 2, [float(i % 2) + i * 1e-3] * 4) for i in range(20)], "id int, y int, features array<double>"), max_iter=50)
    types = V.typed_boxes(V.frame_boxes(frames, cells, models, min_area=4), features, probe, ["stain", "hole"], 16, 4)
    found = {r.image_id: r for r in V.frame_results(frames, cells, models, image_size=16, min_area=4, types=types).collect()}
    one = found[1]
    assert (one.anomaly_score, one.threshold, one.is_defective, one.num_defects, one.defect_points, one.pixels_per_mm, one.original_size) == (90.0, 50.0, True, 1, 2, 0.05, [160, 320])
    box = one.boxes[0]
    assert (box.x, box.y, box.w, box.h, box.area, box.size_mm, box.points, box.type) == (2, 4, 4, 4, 16, 80.0, 2, "hole")
    assert (box.ox, box.oy, box.ow, box.oh) == (20, 80, 40, 80)
    assert (found[2].anomaly_score, found[2].is_defective, found[2].boxes, found[2].pixels_per_mm) == (None, None, [], 5.0)
    assert (found[3].threshold, found[3].is_defective, found[3].num_defects, found[3].pixels_per_mm) == (None, None, 0, 5.0)
