"""Queries on features, banks, scores, maps, regions, metrics, typing and streams, with their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.operators import bank as B
from loomlens.operators import evaluate as E
from loomlens.operators import extractors as N
from loomlens.operators import features as X
from loomlens.operators import grading as G
from loomlens.operators import localize as L
from loomlens.operators import packed as K
from loomlens.operators import ranking as R
from loomlens.operators import rasters as P
from loomlens.operators import typing_probe as Y
from loomlens.operators.graph import shared_table
from loomlens.plans.fixtures import view, with_views
from loomlens.sources import tables as T
from loomlens.streaming import frames as Z

QUERIES, ORACLES = {}, {}
RATIOS = (0.01, 0.05, 0.1, 0.25)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ---- ranking and calibration over labelled scores ----
_CURVE = """, cnt AS (SELECT {g}score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {t} GROUP BY ALL),
 cum AS (SELECT *, sum(pos) OVER (PARTITION BY {p} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {p} ORDER BY score DESC) AS fp,
         sum(pos) OVER (PARTITION BY {p}) AS p, sum(neg) OVER (PARTITION BY {p}) AS n FROM cnt)"""
_IMAGES = with_views("fx_images") + _CURVE.format(g="category, ", t="fx_images", p="category")
_PIXELS = with_views("fx_pixels") + ", px AS (SELECT image_id, score, gt AS label FROM fx_pixels)" + _CURVE.format(g="", t="px", p="1")
_ROC = ", roc AS (SELECT category, score AS threshold, tp / p AS tpr, fp / n AS fpr FROM cum WHERE p > 0 AND n > 0 UNION ALL SELECT DISTINCT category, 'inf'::DOUBLE, 0, 0 FROM cum WHERE p > 0 AND n > 0)"
_YOUDEN = ", you AS (SELECT category, threshold, round(tpr - fpr, 12) AS j FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) AS no FROM roc) WHERE no = 1)"
_BY = ["category"]


def _image_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cumulative(R.score_counts(view(spark, sf_dir, "fx_images"), _BY), _BY)


def _pixel_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cumulative(R.score_counts(view(spark, sf_dir, "fx_pixels"), [], label="gt"), [])


@query(_IMAGES + _ROC + " SELECT category, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.roc_curve(_image_curve(spark, sf_dir), _BY), "tpr", "fpr")


@query(_IMAGES + _ROC + _YOUDEN + " SELECT category, threshold, round(j, 6) AS j FROM you")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.youden_threshold(R.roc_curve(_image_curve(spark, sf_dir), _BY), _BY), "j")


@query(_IMAGES + _ROC + " SELECT category, min(threshold) AS threshold FROM roc WHERE fpr <= 0.05 GROUP BY category")
def target_fpr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.target_fpr_threshold(R.roc_curve(_image_curve(spark, sf_dir), _BY), _BY, 0.05)


@query(with_views("fx_pixels") + " SELECT image_id % 4 AS model, round(quantile_cont(score, 0.01), 6) AS vmin, round(quantile_cont(score, 0.99), 6) AS vmax FROM fx_pixels GROUP BY ALL")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.map_bounds(view(spark, sf_dir, "fx_pixels").withColumn("model", F.col("image_id") % 4), ["model"]), "vmin", "vmax")


@query(_IMAGES + _ROC + _YOUDEN + " SELECT i.category, round(avg(((score > threshold) = (label = 1))::INT), 6) AS accuracy FROM fx_images i JOIN you y ON i.category = y.category GROUP BY i.category")
def calibrated_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = R.youden_threshold(R.roc_curve(_image_curve(spark, sf_dir), _BY), _BY).drop("j")
    return rounded(R.accuracy_at(view(spark, sf_dir, "fx_images"), cut, _BY), "accuracy")


def _models(images: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("double")
    return images.select("category").distinct().select("category", F.lit(1).alias("version"), empty.alias("threshold"), empty.alias("vmin"), empty.alias("vmax"))


@query(_IMAGES + _ROC + _YOUDEN + ", b AS (SELECT category, quantile_cont(score, 0.01) AS vmin, quantile_cont(score, 0.99) AS vmax FROM fx_images GROUP BY category) SELECT b.category, CASE WHEN y.category IS NULL THEN 1 ELSE 2 END AS version, threshold, CASE WHEN y.category IS NOT NULL THEN round(vmin, 6) END AS vmin, CASE WHEN y.category IS NOT NULL THEN round(vmax, 6) END AS vmax FROM b LEFT JOIN you y ON y.category = b.category")
def calibrate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = view(spark, sf_dir, "fx_images")
    cut = R.youden_threshold(R.roc_curve(_image_curve(spark, sf_dir), _BY), _BY).drop("j")
    return rounded(E.latest_models(E.calibrate_model(_models(images), cut, R.map_bounds(images, _BY))), "vmin", "vmax")


_AUC = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(pos * (n - fp) + pos * neg / 2) / (max(p) * max(n)), 6) END"
_AP = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(pos / p * (tp / (tp + fp))), 6) END"


@query(_IMAGES + f" SELECT category, {_AUC} AS auroc FROM cum GROUP BY category")
def image_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auroc_ap(_image_curve(spark, sf_dir), _BY).select("category", "auroc"), "auroc")


@query(_IMAGES + f" SELECT category, {_AP} AS ap FROM cum GROUP BY category")
def image_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auroc_ap(_image_curve(spark, sf_dir), _BY).select("category", "ap"), "ap")


@query(_PIXELS + f" SELECT {_AUC} AS auroc FROM cum")
def pixel_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auroc_ap(_pixel_curve(spark, sf_dir), []).select("auroc"), "auroc")


@query(_PIXELS + f" SELECT {_AP} AS ap FROM cum")
def pixel_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auroc_ap(_pixel_curve(spark, sf_dir), []).select("ap"), "ap")


@query(_IMAGES + " SELECT category, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / nullif(p, 0), 6) AS recall FROM cum")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.pr_curve(_image_curve(spark, sf_dir), _BY), "precision", "recall")


_F1 = ", f AS (SELECT *, round(2 * (tp / (tp + fp)) * (tp / nullif(p, 0)) / (tp / (tp + fp) + tp / nullif(p, 0) + 1e-12::DOUBLE), 12) AS f1 FROM cum), best AS (SELECT category, f1, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, score) AS no FROM f WHERE p > 0 AND n > 0) WHERE no = 1)"


@query(_IMAGES + _F1 + " SELECT category, round(f1, 6) AS f1, threshold FROM best")
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.best_f1(_image_curve(spark, sf_dir), _BY).where("f1 is not null"), "f1")


# ---- classifier metrics over probabilities ----
_TOP = with_views("fx_proba") + ", top AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM fx_proba)"


def _proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_proba").select("id", "y", F.array("p0", "p1", "p2").alias("proba"))


@query(_TOP + ", b AS (SELECT (SELECT max(i) FROM range(10) t(i) WHERE conf > i / 10.0::DOUBLE) AS bin, conf, pred = y AS hit FROM top), g AS (SELECT bin, count(*) AS n, avg(hit::INT) AS acc, avg(conf) AS c FROM b GROUP BY bin) SELECT round(sum(n * abs(acc - c)) / sum(n), 6) AS ece FROM g")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.calibration_error(_proba(spark, sf_dir)), "ece")


@query(_TOP + " SELECT i / 10.0::DOUBLE AS threshold, round(count(*) FILTER (conf >= i / 10.0::DOUBLE) / count(*), 6) AS coverage, round(avg((pred = y)::INT) FILTER (conf >= i / 10.0::DOUBLE), 6) AS selective_accuracy, count(*) FILTER (conf >= i / 10.0::DOUBLE) AS n_predicted FROM top, range(10) t(i) GROUP BY i")
def coverage_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.coverage_accuracy(_proba(spark, sf_dir)), "coverage", "selective_accuracy")


@query(_TOP + " SELECT y, count(*) FILTER (pred = 0) AS n_0, count(*) FILTER (pred = 1) AS n_1, count(*) FILTER (pred = 2) AS n_2, round(avg((pred = y)::INT), 6) AS recall FROM top GROUP BY y")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.confusion_matrix(_proba(spark, sf_dir), 3), "recall")


@query(_TOP + """, per AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (pred = c) AS said, count(*) FILTER (y = c AND pred = c) AS hit FROM top, range(3) t(c) GROUP BY c),
 r AS (SELECT c, hit / said AS pr, hit / support AS re, 2 * hit / (said + support) AS f, support, hit FROM per)
 SELECT c::VARCHAR AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, support FROM r
 UNION ALL SELECT 'macro', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(support)::BIGINT FROM r
 UNION ALL SELECT 'weighted', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM r
 UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM r""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.classification_report(_proba(spark, sf_dir), 3), "precision", "recall", "f1")


# ---- patch features ----
def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_patches")


_CH = ", ch AS (SELECT image_id, row_id AS y, col_id AS x, unnest(range({n})) AS channel, unnest(feature[1:{n}])::DOUBLE AS value, category FROM fx_patches)"


@query(with_views("fx_patches") + _CH.format(n=4) + " SELECT a.image_id, a.channel, a.y, a.x, round(sum(b.value) / 9, 6) AS value FROM ch a JOIN ch b ON a.image_id = b.image_id AND a.channel = b.channel AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL")
def local_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.local_mean(X.channels_of(_patches(spark, sf_dir), 4), 4, 4), "value")


@query(with_views("fx_tokens") + " SELECT image_id, pos - 1 AS i, (pos - 1) // 3 AS row_id, (pos - 1) % 3 AS col_id, round(list_sum(token::DOUBLE[]), 6) AS s FROM fx_tokens WHERE pos >= 1")
def strip_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prefix token, as the extractor declares; a last image that lacks tokens keeps those it has."""
    found = X.patch_tokens(view(spark, sf_dir, "fx_tokens"), 3, 3, prefix=1)
    return found.select("image_id", "i", "row_id", "col_id", F.round(F.aggregate(F.col("token").cast("array<double>"), F.lit(0.0), lambda a, b: a + b), 6).alias("s"))


@query(with_views("fx_tokens") + " SELECT image_id, pos // 5 AS row_id, pos % 5 AS col_id, round(token[1]::DOUBLE, 6) AS first, round(list_sum(list_transform(range(1, 65), lambda i: i * token[i]::DOUBLE)), 5) AS s FROM fx_tokens WHERE image_id IN (SELECT image_id FROM fx_tokens GROUP BY image_id HAVING count(*) = 10)")
def tokens_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with all their tokens; another number of them is an error of the operator."""
    rows = view(spark, sf_dir, "fx_tokens").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]).alias("tokens"))
    total = F.aggregate(F.transform(F.col("token").cast("array<double>"), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return X.tokens_to_grid(rows.where("n = 10").drop("n"), 2, 5).select("image_id", "row_id", "col_id", F.round(F.col("token")[0].cast("double"), 6).alias("first"), F.round(total, 5).alias("s"))


@query(with_views("fx_patches") + " SELECT image_id, row_id, col_id, len(feature[1:8]) + len(feature[9:16]) AS dim, round(list_sum(list_transform(range(1, 17), lambda i: i * feature[i]::DOUBLE)), 5) AS s FROM fx_patches")
def concat_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir)
    layers = [p.withColumn("feature", F.slice("feature", a, 8)) for a in (1, 9)]
    found = X.concat_layers(layers)
    total = F.aggregate(F.transform(F.col("feature").cast("array<double>"), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return found.select("image_id", "row_id", "col_id", F.size("feature").cast("long").alias("dim"), F.round(total, 5).alias("s"))


# Half-pixel bilinear weights of output o over inputs, from n to m.
_BIL = ", pos{m} AS (SELECT o, greatest(0, (o + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE) AS s FROM range({m}) t(o)), w{m} AS (SELECT o, least(floor(s), {n} - 1)::BIGINT AS i, 1 - (s - floor(s)) AS w FROM pos{m} UNION ALL SELECT o, least(floor(s) + 1, {n} - 1)::BIGINT, s - floor(s) FROM pos{m})"


@query(with_views("fx_patches") + _CH.format(n=2) + _BIL.format(n=2, m=4) + ", up AS (SELECT image_id, channel + 2 AS channel, a.o AS y, b.o AS x, sum(value * a.w * b.w) AS value FROM (SELECT * FROM ch WHERE y < 2 AND x < 2) c JOIN w4 a ON c.y = a.i JOIN w4 b ON c.x = b.i GROUP BY ALL) SELECT image_id, y, x, channel, round(value, 6) AS value FROM ch UNION ALL SELECT image_id, y, x, channel, round(value, 6) FROM up")
def concat_mixed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = X.channels_of(_patches(spark, sf_dir), 2)
    return rounded(X.concat_mixed_grids(fine, fine.where("y < 2 and x < 2"), 2, 4, 2), "value")


_RGB = "list_extract([{0}]::DOUBLE[], channel + 1)"
_MEAN, _STD = _RGB.format("0.485, 0.456, 0.406"), _RGB.format("0.229, 0.224, 0.225")


@query(with_views("fx_rgb") + f" SELECT pixel, channel, v, round((v / 255 - {_MEAN}) / {_STD}, 6) AS value FROM fx_rgb")
def normalize_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_rgb").select("pixel", "channel", "v", F.round(X.normalise_channel(F.col("v"), F.col("channel")), 6).alias("value"))


@query(with_views("fx_rgb") + f" SELECT pixel, channel, v, trunc(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v / 50 - 2.5::DOUBLE) * {_STD} + {_MEAN})) * 255)::INT AS value FROM fx_rgb")
def denormalize_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_rgb").select("pixel", "channel", "v", X.denormalise_channel(F.col("v") / 50 - 2.5, F.col("channel")).alias("value"))


@query(with_views("fx_patches") + _CH.format(n=4) + " SELECT image_id, channel, round(coalesce(avg(value) FILTER (image_id % 3 <> 0 AND (y + x + image_id) % 3 = 0), avg(value)), 6) AS value FROM ch GROUP BY ALL")
def pool_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.channels_of(_patches(spark, sf_dir), 4).withColumn("mask", (F.col("image_id") % 3 != 0) & ((F.col("y") + F.col("x") + F.col("image_id")) % 3 == 0))
    return rounded(X.pooled(cells), "value")


@query(with_views("fx_pixels") + " SELECT image_id, y // 4 AS gy, x // 4 AS gx, avg(gt) > 0.5 AS mask FROM fx_pixels GROUP BY ALL")
def downsample_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mask_on_grid(view(spark, sf_dir, "fx_pixels"), 16, 16, 4, 4)


@query(with_views("fx_patches") + " SELECT category, unnest(['grid', 'dimension', 'finite', 'not_empty']) AS check, unnest([max(row_id) > 0 AND max(col_id) > 0, min(len(feature)) = 64 AND max(len(feature)) = 64, bool_and(list_bool_and(list_transform(feature, lambda v: isfinite(v)))), count(*) > 0]) AS ok FROM fx_patches GROUP BY category")
def validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.feature_checks(_patches(spark, sf_dir), 64)


@query()
def extract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as grey images of all their bytes: 8 wide and as high as needed, with zeros up to an even height."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    height = (2 * F.greatest(F.lit(1), F.ceil(F.octet_length("html") / 16))).cast("int")
    images = pages.select(F.col("page_id").alias("image_id"), height.alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.rpad("html", 8 * height, F.lit(b"\0")).alias("data"))
    return N.extract(images, N.statistics_extractor(2, 1))


# ---- banks and nearest neighbours ----
_NORMAL = ", normal AS (SELECT * FROM fx_patches WHERE split = 'train' AND label = 0), test AS (SELECT * FROM fx_patches WHERE split = 'test')"
_KNN = _NORMAL + ", d AS (SELECT t.patch_id, t.image_id, t.label, t.category, list_distance(t.feature::DOUBLE[], b.feature::DOUBLE[]) AS d FROM test t JOIN normal b ON t.category = b.category), knn AS (SELECT category, patch_id, any_value(image_id) AS image_id, any_value(label) AS label, min(d) AS d1, list_avg(list_sort(list(d))[1:3]) AS d3 FROM d GROUP BY ALL)"


@query(with_views("fx_patches") + _NORMAL + " SELECT category, r::DOUBLE AS ratio, n, least(n, greatest(1, floor(n * r::DOUBLE)))::BIGINT AS n_keep FROM (SELECT category, count(*) AS n FROM normal GROUP BY category), (SELECT unnest([0.01, 0.05, 0.1, 0.25]) AS r)")
def bank_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bank_sizes(_patches(spark, sf_dir), RATIOS)


_ARR = """, arr AS (SELECT category, list(feature::DOUBLE[] ORDER BY patch_id) AS f, list(patch_id ORDER BY patch_id) AS ids, arg_min(pos, h) AS first FROM (SELECT *, md5('0|' || patch_id) AS h, row_number() OVER (PARTITION BY category ORDER BY patch_id) AS pos FROM normal) GROUP BY category)"""


@query(with_views("fx_patches") + _NORMAL + _ARR + """,
 g AS (SELECT category, 1 AS k, first AS spot, list_transform(range(1, len(f) + 1), lambda i: list_distance(f[i], f[first])) AS d FROM arr
  UNION ALL SELECT g.category, k + 1, list_position(d, list_max(d)), list_transform(range(1, len(f) + 1), lambda i: least(d[i], list_distance(f[i], f[list_position(d, list_max(d))]))) FROM g JOIN arr ON g.category = arr.category WHERE k < floor(len(f) * 0.1::DOUBLE))
 SELECT g.category, ids[spot] AS patch_id, (k - 1)::INT AS rank FROM g JOIN arr ON g.category = arr.category""")
def coreset_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each category."""
    return B.coreset(B.normal_patches(_patches(spark, sf_dir)), ratio=0.1).select("category", "patch_id", "rank")


coreset_greedy_share = coreset_greedy
QUERIES["coreset_greedy_share"], ORACLES["coreset_greedy_share"] = QUERIES["coreset_greedy"], ORACLES["coreset_greedy"]


@query()
def coreset_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coreset_distributed(B.normal_patches(_patches(spark, sf_dir)), ratio=0.1).select("category", "patch_id", "rank")


@query(with_views("fx_patches") + _NORMAL + """, arr AS (SELECT category, list(feature::DOUBLE[] ORDER BY patch_id) AS f, arg_min(pos, h) AS first FROM (SELECT *, md5('0|' || patch_id) AS h, row_number() OVER (PARTITION BY category ORDER BY patch_id) AS pos FROM normal) GROUP BY category),
 g AS (SELECT category, 1 AS k, list_transform(range(1, len(f) + 1), lambda i: list_distance(f[i], f[first])) AS d FROM arr
  UNION ALL SELECT g.category, k + 1, list_transform(range(1, len(f) + 1), lambda i: least(d[i], list_distance(f[i], f[list_position(d, list_max(d))]))) FROM g JOIN arr ON g.category = arr.category WHERE k < floor(len(f) * 0.25::DOUBLE)),
 sizes AS (SELECT category, len(f) AS n, r::DOUBLE AS ratio, least(len(f), greatest(1, floor(len(f) * r::DOUBLE)))::BIGINT AS n_keep FROM arr, (SELECT unnest([0.01, 0.05, 0.1, 0.25]) AS r))
 SELECT s.category, ratio, n, n_keep, round(n_keep / n, 6) AS kept_share, round(list_max(d), 6) AS radius FROM sizes s JOIN g ON s.category = g.category AND s.n_keep = g.k""")
def bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.bank_statistics(_patches(spark, sf_dir), RATIOS), "kept_share", "radius")


def _knn(spark: SparkSession, sf_dir: str, k: tuple[int, ...] = (1, 3)) -> DataFrame:
    patches = _patches(spark, sf_dir)
    return B.knn_distances(patches.where("split = 'test'"), B.normal_patches(patches), k)


@query(with_views("fx_patches") + _KNN + " SELECT category, patch_id, round(d1, 6) AS d1, round(d3, 6) AS d3 FROM knn")
def knn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_knn(spark, sf_dir), "d1", "d3")


@query()
def knn_score_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = _patches(spark, sf_dir)
    return rounded(B.knn_approximate(patches.where("split = 'test'"), B.normal_patches(patches)), "d1")


@query(with_views("fx_patches") + _KNN + " SELECT category, image_id, label, round(max(d1), 6) AS score FROM knn GROUP BY ALL")
def score_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = _patches(spark, sf_dir).select("patch_id", "image_id", "label")
    return rounded(_knn(spark, sf_dir, (1,)).join(patches, "patch_id").groupBy("category", "image_id", "label").agg(F.max("d1").alias("score")), "score")


_VERDICT = _KNN + ", img AS (SELECT category, image_id, label, max(d1) AS score FROM knn GROUP BY ALL)" + _CURVE.format(g="category, ", t="img", p="category") + _ROC + _YOUDEN


@query(with_views("fx_patches") + _VERDICT + " SELECT i.category, image_id, label, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS is_defective FROM img i LEFT JOIN you y ON i.category = y.category")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From patches to verdicts: bank of normal training patches, distances, image scores, cut-off."""
    patches = _patches(spark, sf_dir).select("patch_id", "image_id", "label")
    images = shared_table(_knn(spark, sf_dir, (1,)).join(patches, "patch_id").groupBy("category", "image_id", "label").agg(F.max("d1").alias("score")))
    cut = R.youden_threshold(R.roc_curve(R.cumulative(R.score_counts(images, _BY), _BY), _BY), _BY).drop("j")
    return rounded(images.join(cut, "category", "left").withColumn("is_defective", F.col("score") > F.col("threshold")), "score", "threshold")


_STORE = " SELECT category, n, round(s, 5) AS bank_sum, 0.1::DOUBLE AS coreset_ratio, NULL::DOUBLE AS threshold FROM (SELECT category, count(*) AS n, sum(list_sum(feature::DOUBLE[])) AS s FROM normal GROUP BY category)"


@query(with_views("fx_patches") + _NORMAL + _STORE)
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and banks written to the shared folder and read back."""
    bank = B.normal_patches(_patches(spark, sf_dir)).select("category", "patch_id", "feature")
    models = bank.select("category").distinct().select("category", F.lit(None).cast("double").alias("coreset_ratio"), F.lit(None).cast("double").alias("threshold"))
    shared_table(models.limit(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/models-{uuid.uuid4().hex}"
    T.save_models(models, bank, path)
    kept, vectors = T.load_models(spark, path)
    total = F.aggregate(F.col("feature").cast("array<double>"), F.lit(0.0), lambda a, b: a + b)
    sums = vectors.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 5).alias("bank_sum"))
    return sums.join(kept, "category").select("category", "n", "bank_sum", "coreset_ratio", "threshold")


# ---- anomaly maps ----
# Cells that a map lacks count as zero.
_MAPS = ", cells AS (SELECT i.image_id, y, x, coalesce(feature[1]::DOUBLE, 0) AS score FROM (SELECT DISTINCT image_id FROM fx_patches) i CROSS JOIN range(4) a(y) CROSS JOIN range(4) b(x) LEFT JOIN fx_patches p ON p.image_id = i.image_id AND p.row_id = y AND p.col_id = x)"


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir).select("image_id", F.col("row_id").alias("y"), F.col("col_id").alias("x"), F.col("feature")[0].cast("double").alias("score"))


_UP = _BIL.format(n=4, m=16) + ", up AS (SELECT image_id, a.o AS y, b.o AS x, sum(score * a.w * b.w) AS score FROM cells c JOIN w16 a ON c.y = a.i JOIN w16 b ON c.x = b.i GROUP BY ALL)"
_BLUR = ", kern AS (SELECT t - 3 AS g, exp(-0.5::DOUBLE * (t - 3) * (t - 3)) / (SELECT sum(exp(-0.5::DOUBLE * (u - 3) * (u - 3))) FROM range(7) q(u)) AS w FROM range(7) q(t)), blur1 AS (SELECT image_id, y - g AS y, x, sum(score * w) AS score FROM up, kern WHERE y - g BETWEEN 0 AND 15 GROUP BY ALL), blur AS (SELECT image_id, y, x - g AS x, sum(score * w) AS score FROM blur1, kern WHERE x - g BETWEEN 0 AND 15 GROUP BY ALL)"


@query(with_views("fx_patches") + _MAPS + _UP + " SELECT image_id, y, x, round(score, 6) + 0.0::DOUBLE AS score FROM up")
def upsample_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.resampled(_maps(spark, sf_dir), 4, 16), "score").withColumn("score", F.col("score") + 0.0)


@query(with_views("fx_patches") + _MAPS + _UP + _BLUR + " SELECT image_id, y, x, round(score, 6) + 0.0::DOUBLE AS score FROM blur")
def smooth_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 0.0 is added, as a map that lacks cells has values that round to -0.0 or 0.0.
    return rounded(P.resampled(_maps(spark, sf_dir), 4, 16, sigma=1.0), "score").withColumn("score", F.col("score") + 0.0)


@query(with_views("fx_patches") + _MAPS + _UP + _BLUR + " SELECT image_id, round(max(score), 6) AS score FROM blur GROUP BY image_id")
def image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = K.pack(_maps(spark, sf_dir), 4, 4)
    return rounded(maps.select("image_id", K.peak(K.weighted("score", P.map_weights(4, 16, 1.0))).alias("score")), "score")


@query(with_views("fx_pixels") + ", b AS (SELECT image_id, min(score) AS lo, max(score) AS hi FROM fx_pixels GROUP BY image_id) SELECT p.image_id, y, x, round(least(1, greatest(0, (score - lo) / (hi - lo + 1e-8::DOUBLE))), 6) AS score FROM fx_pixels p JOIN b ON p.image_id = b.image_id")
def normalize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = K.pack(view(spark, sf_dir, "fx_pixels"), 16, 16)
    return rounded(K.unpack(maps.withColumn("score", K.scaled("score")), 16), "score")


@query(with_views("fx_images") + " SELECT category, image_id, score, no AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, image_id) AS no FROM fx_images) WHERE no <= 6")
def top_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.most_anomalous_by(view(spark, sf_dir, "fx_images"), "category").select("category", "image_id", "score", "rank")


# ---- regions and boxes ----
_FG = ", st AS (SELECT image_id, avg(score) AS m, stddev_pop(score) AS s FROM fx_pixels GROUP BY image_id), fg AS (SELECT p.* FROM fx_pixels p JOIN st ON p.image_id = st.image_id WHERE s >= 1e-6 AND score >= m + 2 * s)"
# Runs of a row, then reachability between touching runs; slack 1 is 8-connectivity.
_COMP = """, {p}r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1, y * 1000 + min(x) AS run FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {t}) GROUP BY image_id, y, g),
 {p}e AS (SELECT a.image_id, a.run AS a, b.run AS b FROM {p}r a JOIN {p}r b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND b.x0 <= a.x1 + {s} AND b.x1 >= a.x0 - {s}),
 {p}t AS (SELECT image_id, run AS a, run AS b FROM {p}r UNION SELECT t.image_id, t.a, e.b FROM {p}t t JOIN {p}e e ON t.image_id = e.image_id AND t.b = e.a),
 {p}l AS (SELECT image_id, a AS run, min(b) AS comp FROM {p}t GROUP BY ALL),
 {p}c AS (SELECT f.*, l.comp FROM {t} f JOIN {p}r r ON f.image_id = r.image_id AND f.y = r.y AND f.x BETWEEN r.x0 AND r.x1 JOIN {p}l l ON r.image_id = l.image_id AND r.run = l.run)"""
_GT = ", gt AS (SELECT * FROM fx_pixels WHERE gt = 1)"
_FIRST = "(comp // 1000) * 2147483648 + comp % 1000"


def _truth(spark: SparkSession, sf_dir: str, connectivity: int) -> DataFrame:
    return L.components(view(spark, sf_dir, "fx_pixels").where("gt = 1"), connectivity)


@query(with_views("fx_pixels") + _FG + " SELECT image_id, y, x, score FROM fg")
def adaptive_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = K.pack(view(spark, sf_dir, "fx_pixels"), 16, 16)
    on = maps.select("image_id", "score", F.explode(K.adaptive_mask("score", 256)).alias("at"))
    return on.select("image_id", F.floor(F.col("at") / 16).alias("y"), (F.col("at") % 16).cast("long").alias("x"), F.get("score", F.col("at")).alias("score"))


@query(with_views("fx_pixels") + ", b AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi FROM fx_pixels), n AS (SELECT image_id, least(1, greatest(0, (score - lo) / (hi - lo + 1e-8::DOUBLE))) AS score FROM fx_pixels, b) SELECT image_id, round(avg((score >= 0.5)::INT), 6) AS flood_share FROM n GROUP BY image_id")
def fixed_mask_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "fx_pixels")
    return rounded(L.flood_share(P.normalised(pixels, R.map_bounds(pixels, []))), "flood_share")


@query(with_views("fx_pixels") + _GT + _COMP.format(p="q", t="gt", s=0) + f" SELECT image_id, y, x, {_FIRST} AS comp FROM qc")
def components_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, 4).select("image_id", "y", "x", "comp")


@query(with_views("fx_pixels") + _GT + _COMP.format(p="q", t="gt", s=1) + f" SELECT image_id, y, x, {_FIRST} AS comp FROM qc")
def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, 8).select("image_id", "y", "x", "comp")


@query(with_views("fx_pixels") + _GT + _COMP.format(p="q", t="gt", s=1) + f" SELECT image_id, y, x, {_FIRST} AS comp FROM qc")
def components_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.components_by_runs(view(spark, sf_dir, "fx_pixels").where("gt = 1"), 8)


_BOXES = _FG + _COMP.format(p="b", t="fg", s=1) + ", boxes AS (SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, round(max(score), 4) AS score FROM bc GROUP BY image_id, comp HAVING count(*) >= {a})"


def _boxes(spark: SparkSession, sf_dir: str, min_area: int = 1) -> DataFrame:
    maps = K.pack(view(spark, sf_dir, "fx_pixels"), 16, 16)
    box = maps.select("image_id", F.explode(K.boxes("score", 16, 16, 2.0, min_area)).alias("b"))
    return box.select("image_id", "b.x", "b.y", "b.w", "b.h", "b.area", F.round("b.score", 4).alias("score"))


@query(with_views("fx_pixels") + _BOXES.format(a=2) + " SELECT * FROM boxes")
def boxes_from_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, 2)


_CELLS = ", hit AS (SELECT DISTINCT p.image_id, p.y, p.x FROM fx_pixels p JOIN boxes b ON p.image_id = b.image_id AND p.y >= b.y AND p.y < b.y + b.h AND p.x >= b.x AND p.x < b.x + b.w)"


@query(with_views("fx_pixels") + _BOXES.format(a=1) + _CELLS + " SELECT * FROM hit")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.covered(_boxes(spark, sf_dir))


_TRUTH_CELLS = _GT + _COMP.format(p="q", t="gt", s=0) + """, tbox AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM qc GROUP BY image_id, comp),
 thit AS (SELECT DISTINCT p.image_id, p.y, p.x FROM fx_pixels p JOIN tbox t ON p.image_id = t.image_id AND p.y BETWEEN t.y0 AND t.y1 AND p.x BETWEEN t.x0 AND t.x1)"""


@query(with_views("fx_pixels") + _BOXES.format(a=1) + _CELLS + _TRUTH_CELLS + """ SELECT coalesce(h.image_id, t.image_id) AS image_id, count(h.x) AS area_found, count(t.x) AS area_truth, count(*) FILTER (h.x IS NOT NULL AND t.x IS NOT NULL) AS area_both, round(count(*) FILTER (h.x IS NOT NULL AND t.x IS NOT NULL) / count(*), 6) AS iou
 FROM hit h FULL JOIN thit t ON h.image_id = t.image_id AND h.y = t.y AND h.x = t.x GROUP BY ALL""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the found boxes, of the boxes around true regions, and of both, per image."""
    areas = L.overlap_areas(_boxes(spark, sf_dir), L.boxes(_truth(spark, sf_dir, 4), 1)).withColumnsRenamed({"area_first": "area_found", "area_second": "area_truth"})
    return rounded(areas.withColumn("iou", F.col("area_both") / (F.col("area_found") + F.col("area_truth") - F.col("area_both"))), "iou")


@query(with_views("fx_pixels") + _BOXES.format(a=1) + " SELECT image_id, x, y, w, h, area, score, gy, gx FROM boxes, range(4) a(gy), range(4) b(gx) WHERE gy >= y // 4 AND gy < greatest(y // 4 + 1, (y + h) // 4) AND gx >= x // 4 AND gx < greatest(x // 4 + 1, (x + w) // 4)")
def box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grid_cells(_boxes(spark, sf_dir), 16, 4, 4)


_PRED = _BOXES.format(a=1) + _CELLS + ", pred AS (SELECT 'adaptive' AS method, * FROM hit UNION ALL SELECT 'fixed', image_id, y, x FROM fx_pixels WHERE score >= 50)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    adaptive = L.covered(_boxes(spark, sf_dir)).withColumn("method", F.lit("adaptive"))
    fixed = L.fixed_mask(view(spark, sf_dir, "fx_pixels"), 50).select("image_id", "y", "x", F.lit("fixed").alias("method"))
    return adaptive.unionByName(fixed)


@query(with_views("fx_pixels") + _PRED + """, ms AS (SELECT unnest(['adaptive', 'fixed']) AS method), per AS (
 SELECT m.method, p.image_id, count(*) FILTER (p.gt = 1) AS g, count(h.x) AS k, count(h.x) FILTER (p.gt = 1) AS b FROM fx_pixels p CROSS JOIN ms m LEFT JOIN pred h ON h.method = m.method AND h.image_id = p.image_id AND h.y = p.y AND h.x = p.x GROUP BY ALL),
 q AS (SELECT method, b / (g + k - b) AS iou, CASE WHEN k = 0 THEN 0 ELSE b / k END AS pr, b / g AS re FROM per WHERE g > 0),
 a AS (SELECT method, count(*) AS n_images, avg(iou) AS iou, avg(pr) AS pr, avg(re) AS re, avg((iou >= 0.5)::INT) AS i5, avg((iou >= 0.75)::INT) AS i7 FROM q GROUP BY method)
 SELECT method, n_images, round(iou, 6) AS iou, round(pr, 6) AS precision, round(re, 6) AS recall, round(i5, 6) AS iou_50, round(i7, 6) AS iou_75, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM a""")
def localization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.localization_quality(view(spark, sf_dir, "fx_pixels"), _predicted(spark, sf_dir))
    return rounded(found, "iou", "precision", "recall", "iou_50", "iou_75", "f1")


@query(with_views("fx_pixels") + _BOXES.format(a=1) + _CELLS + _GT + _COMP.format(p="q", t="gt", s=0) + """, reg AS (SELECT c.image_id, c.comp, count(*) AS area, avg((h.x IS NOT NULL)::INT) AS recall FROM qc c LEFT JOIN hit h ON c.image_id = h.image_id AND c.y = h.y AND c.x = h.x GROUP BY ALL),
 ed AS (SELECT quantile_cont(area, 0.33) AS lo, quantile_cont(area, 0.67) AS hi FROM reg), bins AS (SELECT reg.*, CASE WHEN area < lo THEN 'small' WHEN area < hi THEN 'medium' ELSE 'large' END AS bin FROM reg, ed),
 lab AS (SELECT b.bin, c.score, 1 AS label FROM qc c JOIN bins b ON c.image_id = b.image_id AND c.comp = b.comp UNION ALL SELECT b, score, 0 FROM fx_pixels, (SELECT unnest(['small', 'medium', 'large']) AS b) WHERE gt = 0 AND image_id IN (SELECT image_id FROM gt))""" + _CURVE.format(g="bin, ", t="lab", p="bin") + f", ap AS (SELECT bin, {_AP} AS pixel_ap FROM cum GROUP BY bin) SELECT b.bin, count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg((recall >= 0.5)::INT), 6) AS detected, any_value(pixel_ap) AS pixel_ap FROM bins b JOIN ap ON b.bin = ap.bin GROUP BY b.bin")
def quality_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "fx_pixels")
    return rounded(L.quality_by_size(pixels, shared_table(_truth(spark, sf_dir, 4)), L.covered(_boxes(spark, sf_dir))), "mean_recall", "detected", "pixel_ap")


@query(with_views("fx_pixels") + _GT + _COMP.format(p="q", t="gt", s=0) + """, ends AS (SELECT min(score) AS lo, max(score) AS hi FROM fx_pixels), thr AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS t FROM ends, range(200) r(i)),
 reg AS (SELECT image_id, comp, count(*) AS area FROM qc GROUP BY ALL), nr AS (SELECT count(*) AS n FROM reg), nn AS (SELECT count(*) AS n FROM fx_pixels WHERE gt = 0),
 ov AS (SELECT i, sum(k / (area + 1e-8::DOUBLE)) AS s FROM (SELECT i, image_id, comp, count(*) AS k FROM qc JOIN thr ON score >= t GROUP BY ALL) h JOIN reg ON h.image_id = reg.image_id AND h.comp = reg.comp GROUP BY i),
 fps AS (SELECT i, count(*) AS k FROM fx_pixels JOIN thr ON score >= t WHERE gt = 0 GROUP BY i),
 curve AS (SELECT coalesce(f.k, 0) / (nn.n + 1e-8::DOUBLE) AS fpr, coalesce(s, 0) / nr.n AS pro FROM thr LEFT JOIN ov ON thr.i = ov.i LEFT JOIN fps f ON thr.i = f.i, nr, nn),
 seq AS (SELECT fpr, pro, lag(fpr) OVER w AS f0, lag(pro) OVER w AS p0 FROM curve WINDOW w AS (ORDER BY fpr, pro)),
 parts AS (SELECT CASE WHEN f0 IS NULL THEN least(fpr, 0.3) * pro WHEN fpr <= 0.3 THEN (fpr - f0) * (pro + p0) / 2 WHEN f0 < 0.3 THEN (0.3 - f0) * (p0 + p0 + (pro - p0) * (0.3 - f0) / (fpr - f0)) / 2 ELSE 0 END AS a FROM seq)
 SELECT round(sum(a) / 0.3, 6) AS pro FROM parts""")
def pro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.overlap_score(view(spark, sf_dir, "fx_pixels"), shared_table(_truth(spark, sf_dir, 4))), "pro")


# Runs: pixels of image i belong to category number i % categories.
_RUNS = """, cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS no, (SELECT count(DISTINCT category) FROM fx_images) AS k FROM (SELECT DISTINCT category FROM fx_images)),
 runpx AS (SELECT c.category, p.* FROM fx_pixels p JOIN cats c ON p.image_id % c.k = c.no)"""
_RUN_CURVE = """, {q}cnt AS (SELECT category, score, count(*) FILTER ({l} = 1) AS pos, count(*) FILTER ({l} = 0) AS neg FROM {t} GROUP BY ALL),
 {q}cum AS (SELECT *, sum(pos) OVER (PARTITION BY category ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY category ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n FROM {q}cnt),
 {q}m AS (SELECT category, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (n - fp) + pos * neg / 2) / (max(p) * max(n)) END AS auroc, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos / p * (tp / (tp + fp))) END AS ap,
          CASE WHEN max(p) > 0 AND max(n) > 0 THEN max(2 * (tp / (tp + fp)) * (tp / nullif(p, 0)) / (tp / (tp + fp) + tp / nullif(p, 0) + 1e-12::DOUBLE)) END AS f1, (max(p) + max(n))::BIGINT AS n_test FROM {q}cum GROUP BY category)"""
_RUN_PRO = """, ends AS (SELECT category, min(score) AS lo, max(score) AS hi, count(*) FILTER (gt = 0) AS nn FROM runpx GROUP BY category), thr AS (SELECT category, nn, i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS t FROM ends, range(200) r(i)),
 creg AS (SELECT q.*, c.category FROM qc q JOIN cats c ON q.image_id % c.k = c.no), reg AS (SELECT category, image_id, comp, count(*) AS area FROM creg GROUP BY ALL), nr AS (SELECT category, count(*) AS n FROM reg GROUP BY category),
 ov AS (SELECT h.category, i, sum(k / (area + 1e-8::DOUBLE)) AS s FROM (SELECT x.category, i, image_id, comp, count(*) AS k FROM creg x JOIN thr ON x.category = thr.category AND score >= t GROUP BY ALL) h JOIN reg ON h.image_id = reg.image_id AND h.comp = reg.comp GROUP BY ALL),
 fps AS (SELECT x.category, i, count(*) AS k FROM runpx x JOIN thr ON x.category = thr.category AND score >= t WHERE gt = 0 GROUP BY ALL),
 curve AS (SELECT thr.category, coalesce(f.k, 0) / (nn + 1e-8::DOUBLE) AS fpr, coalesce(s, 0) / nr.n AS pro FROM thr LEFT JOIN ov ON thr.i = ov.i AND thr.category = ov.category LEFT JOIN fps f ON thr.i = f.i AND thr.category = f.category LEFT JOIN nr ON thr.category = nr.category),
 seq AS (SELECT category, fpr, pro, lag(fpr) OVER w AS f0, lag(pro) OVER w AS p0 FROM curve WINDOW w AS (PARTITION BY category ORDER BY fpr, pro)),
 parts AS (SELECT category, CASE WHEN f0 IS NULL THEN least(fpr, 0.3) * pro WHEN fpr <= 0.3 THEN (fpr - f0) * (pro + p0) / 2 WHEN f0 < 0.3 THEN (0.3 - f0) * (p0 + p0 + (pro - p0) * (0.3 - f0) / (fpr - f0)) / 2 ELSE 0 END AS a FROM seq),
 pros AS (SELECT category, sum(a) / 0.3 AS pro FROM parts GROUP BY category)"""


@query(with_views("fx_images", "fx_pixels") + _RUNS + _RUN_CURVE.format(q="i", t="fx_images", l="label") + _RUN_CURVE.format(q="p", t="runpx", l="gt") + _GT + _COMP.format(p="q", t="gt", s=0) + _RUN_PRO + " SELECT im.category, round(im.auroc, 4) AS image_auroc, round(im.ap, 4) AS image_ap, round(im.f1, 4) AS image_f1, round(pm.auroc, 4) AS pixel_auroc, round(pm.ap, 4) AS pixel_ap, round(pm.f1, 4) AS pixel_f1, round(pro, 4) AS pro, im.n_test FROM im LEFT JOIN pm ON im.category = pm.category LEFT JOIN pros ON im.category = pros.category")
def evaluate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    images = view(spark, sf_dir, "fx_images")
    names = images.select("category").distinct()
    numbered = shared_table(names.select("category", (F.row_number().over(Window.orderBy("category")) - 1).cast("long").alias("no")))  # one row per category
    pixels = view(spark, sf_dir, "fx_pixels").withColumn("no", F.col("image_id") % F.lit(max(1, numbered.count())))
    pixels = pixels.join(numbered, "no").drop("no")
    return E.evaluate_runs(images, shared_table(pixels), images.groupBy("category").agg(F.count(F.lit(1)).alias("n_test")), _BY)


# ---- typing ----
@query(with_views("fx_catalog") + " , d AS (SELECT split_part(path, '/', 5) AS defect_type FROM fx_catalog WHERE split_part(path, '/', 5) <> 'good') SELECT defect_type, count(*) AS n, row_number() OVER (ORDER BY defect_type) - 1 AS y FROM d GROUP BY defect_type")
def typing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomlens.operators.splits import catalog_columns

    return Y.label_index(catalog_columns(view(spark, sf_dir, "fx_catalog")).where("label = 1"))


@query(with_views("fx_patches") + _CH.format(n=8) + ", st AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM ch GROUP BY channel) SELECT image_id, y, x, ch.channel, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value FROM ch JOIN st ON ch.channel = st.channel")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.standardised(X.channels_of(_patches(spark, sf_dir), 8), ["image_id", "y", "x"]), "value")


@query(with_views("fx_proba") + ", c AS (SELECT y, count(*) AS n FROM fx_proba GROUP BY y) SELECT y, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Y.class_weights(view(spark, sf_dir, "fx_proba")), "weight")


@query(with_views("fx_images") + ", k AS (SELECT least(5, min(n)) AS k FROM (SELECT count(*) AS n FROM fx_images GROUP BY category)) SELECT image_id, category, ((row_number() OVER (PARTITION BY category ORDER BY md5('0|' || image_id), image_id) - 1) % k)::INT AS fold FROM fx_images, k WHERE k >= 2")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified_folds(view(spark, sf_dir, "fx_images"), "image_id", "category").select("image_id", "category", "fold")


@query()
def train_type_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe of deployment, fitted on all rows; probe_out_of_fold judges the estimator."""
    rows = view(spark, sf_dir, "fx_proba").select("y", F.array("p0", "p1", "p2").alias("features"))
    counted = rows.groupBy("features", "y").agg(F.count(F.lit(1)).alias("n"))  # equal rows are scored once
    return E.with_top(Y.probabilities(Y.train_probe(rows), counted)).groupBy("y", "pred").agg(F.sum("n").alias("n"))


@query()
def calibrate_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration errors, each fold calibrated by the other folds."""
    rows = view(spark, sf_dir, "fx_proba")
    rows = rows.select(F.xxhash64(*rows.columns).alias("id"), "y", F.array("p0", "p1", "p2").alias("proba"))
    folded = E.stratified_folds(rows, "id", "y").groupBy("fold", "y", "proba").agg(F.count(F.lit(1)).alias("n"))
    folded = shared_table(folded)  # equal rows of a fold count as one, with their number
    found = E.calibration_error(rows).withColumn("kind", F.lit("raw"))
    for method in ("sigmoid", "isotonic"):
        found = found.unionByName(E.calibration_error(Y.calibrated(folded, 3, method, "n"), n="n").withColumn("kind", F.lit(method)))
    return rounded(found, "ece")


# ---- the same operators on whole features ----
def _whole(name: str, *changes: tuple[str, str]) -> str:
    """The SQL of a query on first channels, made to take all 64."""
    sql = ORACLES[name]
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"{name} has no {old}")
        sql = sql.replace(old, new)
    return sql


def _all(n: int) -> tuple[str, str]:
    return _CH.format(n=n), _CH.format(n=64)


@query(_whole("local_aggregate", _all(4)))
def local_aggregate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.channels_of(X.local_mean_features(_patches(spark, sf_dir), 4, 4)), "value")


@query(_whole("pool_features", _all(4)))
def pool_features_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _patches(spark, sf_dir).withColumn("mask", (F.col("image_id") % 3 != 0) & ((F.col("row_id") + F.col("col_id") + F.col("image_id")) % 3 == 0))
    return rounded(X.pooled_features(cells).select("image_id", F.posexplode("feature").alias("channel", "value")), "value")


@query(_whole("concat_mixed_grids", _all(2), ("channel + 2 AS", "channel + 64 AS")))
def concat_mixed_grids_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = _patches(spark, sf_dir).select("image_id", "row_id", "col_id", "feature")
    coarse = X.resampled_features(fine.where("row_id < 2 and col_id < 2"), 2, 4)
    both = X.channels_of(fine).unionByName(X.channels_of(coarse).withColumn("channel", F.col("channel") + 64))
    return rounded(both, "value")


@query(_whole("concat_layers", ("feature[1:8]", "feature[1:32]"), ("feature[9:16]", "feature[33:64]"), ("range(1, 17)", "range(1, 65)")))
def concat_layers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir)
    found = X.concat_layers([p.withColumn("feature", F.slice("feature", a, 32)) for a in (1, 33)])
    total = F.aggregate(F.transform(F.col("feature").cast("array<double>"), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return found.select("image_id", "row_id", "col_id", F.size("feature").cast("long").alias("dim"), F.round(total, 5).alias("s"))


@query(_whole("standardize", _all(8)))
def standardize_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.channels_of(X.standardised_features(_patches(spark, sf_dir))), "value")


# The whole forms are the queries; their earlier names on first channels mean the same now.
for _name in ("local_aggregate", "pool_features", "concat_mixed_grids", "concat_layers", "standardize"):
    QUERIES[_name], ORACLES[_name] = QUERIES[f"{_name}_whole"], ORACLES[f"{_name}_whole"]


# ---- streams ----
def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The frames as a file stream over the events table, and a folder for its state."""
    shared_table(spark.range(0))
    home = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A file source reads folders; a single file's folder is narrowed to its name.
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if events.inputFiles()[0].endswith("/events.parquet") else spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet")
    value = F.col("value")
    frames = rows.select(F.col("event_id").alias("frame_id"), "ts", (F.col("user_id") % 10).alias("roll_id"), value.alias("score"), F.when(value > 50, 2).when(value > 25, 1).otherwise(0).alias("num_defects"), (F.col("event_id") % 101 == 0).alias("failed"))
    return frames, home


@query(with_views("fx_frames") + " SELECT frame_id, CASE WHEN roll_id < 5 THEN 40.0::DOUBLE END AS threshold, CASE WHEN roll_id < 5 THEN score > 40 END AS is_defective, coalesce(CASE WHEN roll_id < 5 THEN score > 40 END, num_defects > 0) AS defective FROM fx_frames")
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, home = _stream(spark, sf_dir)
    models = spark.createDataFrame([(f"roll{i}", 40.0) for i in range(5)], "category string, threshold double")
    rows = Z.verdicts(frames.withColumn("category", F.concat(F.lit("roll"), F.col("roll_id").cast("string"))), models)
    return Z.run_to_parquet(rows.select("frame_id", "threshold", "is_defective", "defective"), f"{home}/out", f"{home}/state")


@query(with_views("fx_frames") + " SELECT roll_id, count(*) AS total, count(*) FILTER (NOT failed AND num_defects > 0) AS defective, sum(CASE WHEN failed THEN 0 ELSE num_defects END)::BIGINT AS points, count(*) - count(*) FILTER (NOT failed AND num_defects > 0) AS passed, true AS complete FROM fx_frames GROUP BY roll_id")
def stream_finished_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per roll, emitted by the batch that brings its last frame; every frame is sent twice."""
    frames, home = _stream(spark, sf_dir)
    expected = view(spark, sf_dir, "fx_frames").groupBy("roll_id").agg(F.count(F.lit(1)).alias("expected"))
    sent = frames.unionByName(frames).join(expected, "roll_id").withColumns({"is_defective": F.lit(None).cast("boolean"), "points": F.col("num_defects")})
    return Z.run_to_parquet(Z.finished_rolls(sent), f"{home}/out", f"{home}/state")


@query(with_views("fx_frames") + " SELECT roll_id, count(*) AS total, count(*) AS done, count(*) FILTER (NOT failed AND num_defects > 0) AS defective, sum(CASE WHEN failed THEN 0 ELSE num_defects END)::BIGINT AS points, count(*) - count(*) FILTER (NOT failed AND num_defects > 0) AS passed FROM fx_frames GROUP BY roll_id")
def stream_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, home = _stream(spark, sf_dir)
    twice = frames.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = twice.unionByName(twice)  # every frame is sent again, and counts once
    rows = Z.running_summary(twice.withColumns({"is_defective": F.lit(None).cast("boolean"), "points": F.col("num_defects")}), "roll_id", delay="1 day")
    return Z.run_to_latest(rows, ["roll_id"], f"{home}/out", f"{home}/state")


@query(with_views("fx_frames") + ", s AS (SELECT roll_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_frames, sum(num_defects)::BIGINT AS points FROM fx_frames GROUP BY ALL), p AS (SELECT *, points * 3600.0::DOUBLE / (n_frames * (224 / 5.0::DOUBLE) / 914.4::DOUBLE * (224 / 5.0::DOUBLE / 25.4::DOUBLE)) AS p FROM s) SELECT roll_id, day, n_frames, points, round(p, 4) AS p100, CASE WHEN p <= 40 THEN 'first' ELSE 'second' END AS grade FROM p")
def stream_roll_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, home = _stream(spark, sf_dir)
    return Z.run_to_latest(Z.windowed_grades(frames), ["roll_id", "day"], f"{home}/out", f"{home}/state")
