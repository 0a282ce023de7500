"""Queries on whole frames and rolls, and on stored probes and defect tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.operators import evaluate as E
from loomlens.operators import features as X
from loomlens.operators import grouped_probes as W
from loomlens.operators import inspect as I
from loomlens.operators import ranking as R
from loomlens.operators import rasters as P
from loomlens.operators import sweeps as S
from loomlens.operators import typing_probe as Y
from loomlens.operators.graph import shared_folder, shared_table
from loomlens.plans.fixtures import view, with_views
from loomlens.plans.grading_queries import _POINTS
from loomlens.plans.score_queries import _BOXES, _KNN
from loomlens.sources import tables as T

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Maps are the images of fx_pixels, 16 a side; two categories by turns, the second without a threshold.
_MODELS = ", model AS (SELECT image_id % 2 AS c, CASE WHEN image_id % 2 = 0 THEN 60.0::DOUBLE END AS threshold, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM fx_pixels GROUP BY ALL), npx AS (SELECT image_id, y, x, least(1, greatest(0, (score - lo) / (hi - lo + 1e-8::DOUBLE))) AS score FROM fx_pixels JOIN model ON image_id % 2 = c)"
_FOUND = with_views("fx_pixels") + _MODELS + _BOXES.replace("fx_pixels", "npx").format(a=2)


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pixels = view(spark, sf_dir, "fx_pixels")
    category = F.concat(F.lit("cat"), (F.col("image_id") % 2).cast("string")).alias("category")
    frames = pixels.select("image_id").distinct().select("image_id", category, F.lit(640).alias("width"), F.lit(480).alias("height"), F.when(F.col("image_id") % 3 > 0, F.lit(0.05)).alias("ppm"))
    bounds = R.map_bounds(pixels.select("score", category), ["category"])
    return frames, pixels, bounds.withColumn("threshold", F.when(F.col("category") == "cat0", F.lit(60.0)))


# A stored probe of two types per category on the mean of a cell's scores, with calibrators; below 0.6 it abstains.
_TYPES = """, grid AS (SELECT image_id, y // 4 AS gy, x // 4 AS gx, avg(score) / 100 AS f FROM fx_pixels GROUP BY ALL),
 touched AS (SELECT b.image_id, b.y, b.x, b.w, b.h, b.area, avg(f) AS f FROM boxes b JOIN grid g ON b.image_id = g.image_id AND gy >= b.y // 4 AND gy < greatest(b.y // 4 + 1, (b.y + b.h) // 4) AND gx >= b.x // 4 AND gx < greatest(b.x // 4 + 1, (b.x + b.w) // 4) GROUP BY ALL),
 raw AS (SELECT *, 1 / (1 + exp(-CASE WHEN image_id % 2 = 0 THEN 4 * f - 1.5::DOUBLE ELSE 3 - 6 * f END)) AS p FROM touched),
 calibrated AS (SELECT *, 1 / (1 + exp(-(5 * (1 - p) - 2.5::DOUBLE))) AS q0, 1 / (1 + exp(-(5 * p - 2.5::DOUBLE))) AS q1 FROM raw),
 typed AS (SELECT *, CASE WHEN greatest(q0, q1) / (q0 + q1) < 0.6::DOUBLE THEN 'unknown' WHEN q0 >= q1 THEN 'stain' ELSE 'hole' END AS type FROM calibrated)"""


def _types(spark: SparkSession, frames: DataFrame, pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes typed by probes that were saved and loaded again."""
    probes = [(f'["=cat{i}"]', ([0.0, 0.0, a, b], [0.0], [1.0], 2, [1.0, 1.0], [5.0, 5.0], [-2.5, -2.5])) for i, (a, b) in enumerate(((4.0, -1.5), (-6.0, 3.0)))]
    path = f"{shared_folder(spark)}/probes-{uuid.uuid4().hex}"
    W.save_probes(spark.createDataFrame(probes, f"model string, probe {W._PROBE}"), path, ["stain", "hole"], 0.6)
    stored, labels, threshold = W.load_probes(spark, path)
    cells = pixels.groupBy("image_id", F.floor(F.col("y") / 4).alias("row_id"), F.floor(F.col("x") / 4).alias("col_id")).agg(F.array(F.avg("score") / 100).alias("feature"))
    return I.typed_boxes(boxes.join(frames.select("image_id", "category"), "image_id"), cells, W.GroupedProbes(stored, ["category"]), labels, 16, 4, threshold)


@query(_FOUND + _TYPES + ", sized AS (SELECT *, round(greatest(w, h) / CASE WHEN image_id % 3 > 0 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END, 1) AS size_mm FROM boxes JOIN typed USING (image_id, y, x, w, h, area)), pointed AS (SELECT *, " + _POINTS.format(hole="false", size="size_mm") + """ AS p FROM (SELECT * EXCLUDE (p) FROM sized)),
 per AS (SELECT image_id, count(*) AS n, sum(p)::BIGINT AS points, string_agg(concat_ws(',', x, y, w, h, area, p, x * 640 // 16, y * 480 // 16, w * 640 // 16, h * 480 // 16, type), ';' ORDER BY y, x, w, h) AS boxes FROM pointed GROUP BY image_id),
 img AS (SELECT image_id, max(score) AS s FROM fx_pixels GROUP BY image_id)
 SELECT i.image_id, 'cat' || (i.image_id % 2) AS category, round(s, 4) AS anomaly_score, s > threshold AS is_defective, threshold, coalesce(n, 0)::INT AS num_defects, coalesce(boxes, '') AS boxes, coalesce(points, 0) AS defect_points
 FROM img i JOIN model ON i.image_id % 2 = c LEFT JOIN per p ON p.image_id = i.image_id""")
def frame_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from raw maps to nested results with types; the boxes are written out as text here. Maps are packed once, by a table."""
    frames, pixels, models = _frames(spark, sf_dir)
    maps, models = shared_table(I.packed_maps(pixels, 16)), shared_table(models)
    types = _types(spark, frames, pixels, I.frame_boxes(frames, maps, models, min_area=2, image_size=16))
    found = I.frame_results(frames, maps, models, image_size=16, ppm=0.1, min_area=2, types=types)
    text = F.array_join(F.transform("boxes", lambda b: F.concat_ws(",", *[b[c].cast("string") for c in ("x", "y", "w", "h", "area", "points", "ox", "oy", "ow", "oh", "type")])), ";")
    return found.select("image_id", "category", "anomaly_score", "is_defective", "threshold", "num_defects", text.alias("boxes"), "defect_points")


@query(with_views("fx_pixels") + """, m AS (SELECT image_id, count(*) = 256 AND count(DISTINCT y * 16 + x) = 256 AS complete, bool_and(isfinite(score)) AS fine, max(score) >= 0 AS peak FROM fx_pixels GROUP BY image_id)
 SELECT image_id, unnest(['size', 'finite', 'score']) AS check, unnest([complete, fine, peak]) AS ok FROM m""")
def validate_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "fx_pixels")
    return X.map_checks(pixels, P.image_scores(pixels, "image_id"), 16)


# Eight maps make a strip: windows of 256 pixels, 0.5 pixels a mm.
_SCAN = _FOUND + """, placed AS (SELECT image_id // 8 AS roll_id, (image_id % 8) * 256 + x * 16 AS x_px, y * 16 AS y_px, w * 16 AS w_px, h * 16 AS h_px FROM boxes),
 sized AS (SELECT *, greatest(w_px, h_px) / 0.5::DOUBLE AS size_mm FROM placed)"""


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames, pixels, models = _frames(spark, sf_dir)
    strips = frames.groupBy(F.floor(F.col("image_id") / 8).alias("roll_id")).agg((F.max(F.col("image_id") % 8 + 1) * 256).alias("width_px")).withColumn("height_px", F.lit(256).cast("long"))
    windows = I.strip_windows(strips).withColumn("image_id", F.col("roll_id") * 8 + F.col("tile_idx")).join(frames.select("image_id", "category"), "image_id")
    return I.scan_rolls(strips, windows, pixels, models, image_size=16, ppm=0.5, min_area=2)


@query(_SCAN + ", pointed AS (SELECT *, " + _POINTS.format(hole="false", size="round(size_mm, 1)") + """ AS p FROM sized), rolls AS (SELECT image_id // 8 AS roll_id, max(image_id % 8 + 1) * 256 / 0.5::DOUBLE / 914.4::DOUBLE AS yd, 256 / 0.5::DOUBLE / 25.4::DOUBLE AS inch FROM fx_pixels GROUP BY ALL),
 per AS (SELECT r.*, coalesce(sum(p), 0)::BIGINT AS total_points, count(p) AS n_defects FROM rolls r LEFT JOIN pointed q ON q.roll_id = r.roll_id GROUP BY ALL), rated AS (SELECT *, total_points * 3600.0::DOUBLE / (yd * inch) AS p100 FROM per)
 SELECT roll_id, total_points, n_defects, round(yd, 3) AS length_yd, round(inch, 2) AS width_in, round(p100, 2) AS p100, CASE WHEN p100 <= 40 THEN 'first' ELSE 'second' END AS grade FROM rated""")
def scan_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips from windows and raw maps to grades."""
    return _scan(spark, sf_dir)[1]


@query(_SCAN + " SELECT round(x_px / 0.5::DOUBLE, 1) AS pos_mm, round(size_mm, 1) AS size_mm, " + _POINTS.format(hole="false", size="size_mm") + " AS points, x_px AS x, y_px AS y, w_px AS w, h_px AS h FROM sized")
def defect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects of all strips, written as CSV with a header and read back."""
    path = f"{shared_folder(spark)}/defects-{uuid.uuid4().hex}"
    T.write_defects(_scan(spark, sf_dir)[0], path)
    return spark.read.option("header", True).schema("pos_mm double, size_mm double, points int, x long, y long, w long, h long").csv(path)


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_proba")
    return rows.select(F.xxhash64(*rows.columns).alias("id"), "y", F.array("p0", "p1", "p2").alias("features"))


def _by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_rows(spark, sf_dir).withColumn("category", F.concat(F.lit("cat"), F.pmod("id", F.lit(4)).cast("string")))


@query()
def probe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probes of all categories, saved and loaded: rows by class and by whether both give the same probabilities."""
    rows, path = _by_category(spark, sf_dir), f"{shared_folder(spark)}/probes-{uuid.uuid4().hex}"
    probes = W.fit_calibrated(rows, ["category"], 3)
    W.save_probes(probes, path, ["hole", "stain", "slub"], 0.34)
    again, labels, threshold = W.load_probes(spark, path)
    counted = shared_table(rows.groupBy("category", "features").agg(F.count(F.lit(1)).alias("n")))  # equal features are scored once
    first = W.probabilities(counted, probes, ["category"], "features").withColumnRenamed("proba", "first")
    both = W.probabilities(first, again, ["category"], "features")
    kind, _ = Y.predicted_type(F.col("proba"), labels, threshold)
    same = F.forall(F.zip_with("first", "proba", lambda a, b: F.abs(a - b) < 1e-12), lambda x: x)
    return both.groupBy("category", kind.alias("type"), same.alias("same")).agg(F.sum("n").alias("n"))


@query()
def probe_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each row by the calibrated estimator that was fitted on the other of five folds of its category, with inner
    folds of its own: all categories, folds and members in one job."""
    scored = W.out_of_fold(_by_category(spark, sf_dir), ["category"], 3)
    return E.with_top(scored).groupBy("category", "y", "pred").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 4).alias("mean_conf"))


# Runs with whole banks, as SQL can score those, and four that can't run.
_CONFIGS = ", config AS (SELECT DISTINCT category || '-' || k AS config_id, category, 1.0::DOUBLE AS coreset_ratio, k::INT AS n_neighbors FROM fx_patches, (VALUES (1), (3)) t(k) UNION ALL VALUES ('none', 'cat9', 1.0::DOUBLE, 1), ('ratio', 'cat0', 0.0::DOUBLE, 1), ('k', 'cat1', 1.0::DOUBLE, 0), ('odd', 'cat1', 1.0::DOUBLE, 2))"


@query(with_views("fx_patches") + _KNN + _CONFIGS + """,
 scored AS (SELECT c.config_id, k.image_id, k.label, max(CASE WHEN n_neighbors = 1 THEN d1 ELSE d3 END) AS score FROM config c JOIN knn k ON c.category = k.category AND coreset_ratio = 1 AND n_neighbors IN (1, 3) GROUP BY ALL),
 auc AS (SELECT p.config_id, avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) AS auroc FROM scored p JOIN scored n ON p.config_id = n.config_id AND p.label = 1 AND n.label = 0 GROUP BY p.config_id),
 facts AS (SELECT category, count(DISTINCT image_id) FILTER (split = 'train' AND label = 0) AS n_train, count(DISTINCT image_id) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train' AND label = 0) AS bank, max(len(feature)) AS dim FROM fx_patches GROUP BY category)
 SELECT c.config_id, c.category, coreset_ratio, n_neighbors, CASE WHEN e IS NULL THEN 'done' ELSE 'failed' END AS status, e AS error, n_train, n_test, CASE WHEN e IS NULL THEN bank END AS bank_size, dim::INT AS feature_dim, CASE WHEN e IS NULL THEN round(auroc, 6) END AS image_auroc
 FROM (SELECT *, CASE WHEN category = 'cat9' THEN 'no such category' WHEN coreset_ratio <= 0 THEN 'coreset_ratio must be above 0 and at most 1' WHEN n_neighbors < 1 THEN 'n_neighbors must be at least 1' WHEN n_neighbors = 2 THEN 'n_neighbors isn''t among those asked for' END AS e FROM config) c
 LEFT JOIN facts f ON f.category = c.category LEFT JOIN auc a ON a.config_id = c.config_id""")
def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All configurations in one job; those that can't run are recorded with their error."""
    patches = view(spark, sf_dir, "fx_patches")
    good = patches.select("category").distinct().select(F.explode(F.array(F.lit(1), F.lit(3))).alias("k"), "category")
    configs = good.select(F.concat("category", F.lit("-"), F.col("k").cast("string")).alias("config_id"), "category", F.lit(1.0).alias("coreset_ratio"), F.col("k").alias("n_neighbors"))
    bad = spark.createDataFrame([("none", "cat9", 1.0, 1), ("ratio", "cat0", 0.0, 1), ("k", "cat1", 1.0, 0), ("odd", "cat1", 1.0, 2)], "config_id string, category string, coreset_ratio double, n_neighbors int")
    found = S.run_sweep(configs.unionByName(bad), patches, (1, 3)).drop("image_ap", "image_f1")
    return found.withColumn("image_auroc", F.round("image_auroc", 6))


# Two extractors by order status, and order priorities 1 and 2 as the benchmark.
_AB = ", run AS (SELECT category, layer_set AS extractor, pro FROM fx_runs)"


@query(with_views("fx_runs") + _AB + " SELECT category, 'pro' AS metric, round(max(pro) FILTER (extractor = 'F'), 6) AS first, round(max(pro) FILTER (extractor = 'O'), 6) AS second, round(max(pro) FILTER (extractor = 'O') - max(pro) FILTER (extractor = 'F'), 6) AS gain FROM run GROUP BY category")
def compare_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "fx_runs").withColumnRenamed("layer_set", "extractor")
    return S.compare_extractors(runs, "F", "O", ["pro"]).select("category", "metric", *[F.round(c, 6).alias(c) for c in ("first", "second", "gain")])


@query(with_views("fx_runs") + _AB + ", side AS (SELECT extractor, avg(pro) FILTER (category NOT IN ('1-URGENT', '2-HIGH')) AS b, avg(pro) FILTER (category IN ('1-URGENT', '2-HIGH')) AS r FROM run GROUP BY extractor) SELECT extractor, 'pro' AS metric, round(b, 6) AS benchmark, round(r, 6) AS real, round(b - r, 6) AS gap FROM side")
def benchmark_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "fx_runs").withColumnRenamed("layer_set", "extractor")
    return S.benchmark_gap(runs, ["1-URGENT", "2-HIGH"], ["pro"]).select("extractor", "metric", *[F.round(c, 6).alias(c) for c in ("benchmark", "real", "gap")])
