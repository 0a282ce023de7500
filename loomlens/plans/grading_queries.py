"""Queries on grading, reporting, catalogs and splits, each with its DuckDB form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.functions import columns as C
from loomlens.operators import evaluate as E
from loomlens.operators import grading as G
from loomlens.operators import splits as S
from loomlens.operators.graph import shared_folder
from loomlens.operators.typing_probe import predicted_type
from loomlens.plans.fixtures import view, with_views
from loomlens.sources import tables as T

QUERIES, ORACLES = {}, {}
KINDS = ("hole", "stain", "slub")


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# What several DuckDB queries share.
_POINTS = """CASE WHEN coalesce({hole}, false) THEN CASE WHEN {size} / 25.4 <= 1 THEN 2 ELSE 4 END
  WHEN {size} / 25.4 <= 3 THEN 1 WHEN {size} / 25.4 <= 6 THEN 2 WHEN {size} / 25.4 <= 9 THEN 3 ELSE 4 END"""
_SIZED = ", sized AS (SELECT *, greatest(w_px, h_px) / ppm AS size_mm FROM fx_defects), graded AS (SELECT *, " + _POINTS.format(hole="is_hole", size="size_mm") + " AS points FROM sized)"
_ROLLS = """, sums AS (SELECT roll_id, sum(points) AS points, count(*) AS n FROM {graded} GROUP BY roll_id),
 rolls AS (SELECT r.roll_id, coalesce(points, 0) AS pts, coalesce(n, 0) AS n, length_mm / 914.4::DOUBLE AS yd, width_mm / 25.4::DOUBLE AS inch
           FROM fx_rolls r LEFT JOIN sums s ON r.roll_id = s.roll_id),
 per AS (SELECT *, CASE WHEN yd <= 0 OR inch <= 0 THEN 0 ELSE pts * 3600.0::DOUBLE / (yd * inch) END AS p FROM rolls)
 SELECT roll_id, pts::BIGINT AS total_points, n AS n_defects, round(yd, 3) AS length_yd, round(inch, 2) AS width_in, round(p, 2) AS p100,
        CASE WHEN p <= 40 THEN 'first' ELSE 'second' END AS grade FROM per"""


@query(with_views("fx_defects") + _SIZED + " SELECT roll_id, w_px, h_px, is_hole, points FROM graded")
def defect_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sized(view(spark, sf_dir, "fx_defects")).select("roll_id", "w_px", "h_px", "is_hole", "points")


@query(with_views("fx_defects") + " SELECT roll_id, w_px, h_px, round(greatest(w_px, h_px) / ppm, 6) AS size_mm FROM fx_defects")
def defect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_defects").select("roll_id", "w_px", "h_px", F.round(C.size_mm(F.col("w_px"), F.col("h_px"), F.col("ppm")), 6).alias("size_mm"))


@query(with_views("fx_rolls") + " SELECT roll_id, round(CASE WHEN length_mm <= 0 THEN 0 ELSE 7 * 3600.0::DOUBLE / (length_mm / 914.4::DOUBLE * (width_mm / 25.4::DOUBLE)) END, 6) AS p100 FROM fx_rolls")
def points_per_100sqyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p100 = C.points_per_100sqyd(F.lit(7), F.col("length_mm") / C.MM_PER_YARD, F.col("width_mm") / C.MM_PER_INCH)
    return view(spark, sf_dir, "fx_rolls").select("roll_id", F.round(p100, 6).alias("p100"))


@query(with_views("fx_defects", "fx_rolls") + _SIZED + _ROLLS.format(graded="graded"))
def roll_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roll_grades(view(spark, sf_dir, "fx_rolls"), G.sized(view(spark, sf_dir, "fx_defects")))


@query(with_views("fx_defects", "fx_rolls") + ", sized AS (SELECT *, round(greatest(w_px, h_px) / ppm, 1) AS size_mm FROM fx_defects), graded AS (SELECT *, " + _POINTS.format(hole="is_hole", size="size_mm") + " AS points FROM sized)" + _ROLLS.format(graded="graded"))
def roll_grade_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roll_grades(view(spark, sf_dir, "fx_rolls"), G.sized(view(spark, sf_dir, "fx_defects"), round_first=True))


@query(with_views("fx_defects", "fx_rolls") + _SIZED + ", graded_rolls AS (SELECT * FROM (WITH " + _ROLLS.format(graded="graded").lstrip(", ") + ")) SELECT g.roll_id, points, CASE WHEN points >= 3 THEN 'Major' ELSE 'Minor' END AS severity, CASE WHEN grade = 'first' THEN 'ACCEPTED' ELSE 'REJECTED' END AS disposition, count(*) AS n FROM graded g JOIN graded_rolls r ON g.roll_id = r.roll_id GROUP BY ALL")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = G.sized(view(spark, sf_dir, "fx_defects"))
    rolls = G.roll_grades(view(spark, sf_dir, "fx_rolls"), graded).select("roll_id", C.disposition(F.col("grade")).alias("disposition"))
    counts = graded.groupBy("roll_id", "points").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(rolls, "roll_id").select("roll_id", "points", C.severity(F.col("points")).alias("severity"), "disposition", "n")


# Windows of 256 pixels along each strip (a line item is a box in the window of its number), 5 pixels a mm.
_INSPECT = """, boxes AS (SELECT roll_id, (l % 8) * 256 AS x0, floor(w / 10) AS x, floor(h % 224) AS y, 5 + w % 90 AS w, 5 + h % 60 AS h, false AS is_hole
   FROM (SELECT l_orderkey AS roll_id, l_linenumber AS l, l_quantity * 30 AS w, cast(l_partkey % 1500 AS double) AS h FROM lineitem)),
 placed AS (SELECT roll_id, is_hole, x0 + trunc(x * (256 / 224.0::DOUBLE))::BIGINT AS x_px, trunc(y * (256 / 224.0::DOUBLE))::BIGINT AS y_px,
            trunc(w * (256 / 224.0::DOUBLE))::BIGINT AS w_px, trunc(h * (256 / 224.0::DOUBLE))::BIGINT AS h_px FROM boxes),
 sized AS (SELECT *, greatest(w_px, h_px) / 5.0::DOUBLE AS size_mm FROM placed)"""


def _window_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w, h = F.col("l_quantity") * 30, (F.col("l_partkey") % 1500).cast("double")
    return items.select(F.col("l_orderkey").alias("roll_id"), ((F.col("l_linenumber") % 8) * 256).cast("long").alias("x0"), F.floor(w / 10).alias("x"), F.floor(h % 224).alias("y"), (5 + w % 90).alias("w"), (5 + h % 60).alias("h"), F.lit(False).alias("is_hole"))


@query(with_views("fx_defects") + _INSPECT + " SELECT roll_id, x_px, y_px, w_px, h_px, round(x_px / 4096.0::DOUBLE * 100, 6) AS x_percent FROM sized")
def rescale_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = G.located(_window_boxes(spark, sf_dir), F.col("x0"), F.lit(256), 224)
    return placed.select("roll_id", "x_px", "y_px", "w_px", "h_px", F.round(F.col("x_px") / 4096.0 * 100, 6).alias("x_percent"))


@query(with_views("fx_rolls") + _INSPECT + ", graded AS (SELECT *, " + _POINTS.format(hole="is_hole", size="size_mm") + " AS listed, " + _POINTS.format(hole="is_hole", size="round(size_mm, 1)") + """ AS points, round(x_px / 5.0::DOUBLE, 1) AS pos_mm FROM sized),
 listed AS (SELECT roll_id, sum(listed)::BIGINT AS listed_points, max(pos_mm) AS last_pos_mm FROM graded GROUP BY roll_id),
 grades AS (SELECT * FROM (WITH """ + _ROLLS.format(graded="graded").lstrip(", ") + ")) SELECT g.*, listed_points, last_pos_mm FROM grades g LEFT JOIN listed l ON g.roll_id = l.roll_id")
def inspect_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = G.located(_window_boxes(spark, sf_dir), F.col("x0"), F.lit(256), 224).withColumn("ppm", F.lit(5.0))
    size = C.size_mm(F.col("w_px"), F.col("h_px"), F.col("ppm"))
    found = placed.select("roll_id", C.defect_points(size, F.col("is_hole")).alias("listed"), C.defect_points(F.round(size, 1), F.col("is_hole")).alias("points"), F.round(F.col("x_px") / F.col("ppm"), 1).alias("pos_mm"))
    listed = found.groupBy("roll_id").agg(F.sum("listed").alias("listed_points"), F.max("pos_mm").alias("last_pos_mm"))
    return G.roll_grades(view(spark, sf_dir, "fx_rolls"), found).join(listed, "roll_id", "left")


# Frames with boxes: as many as num_defects, types and confidences by arithmetic; thresholds by roll.
_FRAMES = """, boxed AS (SELECT f.*, i, [NULL, 'unknown', 'hole', 'stain'][((frame_id + i) % 4 + 1)::INT] AS type, ((frame_id * 7 + i) % 100) / 100.0::DOUBLE AS conf,
    round(score * i, 1) AS size_mm FROM fx_frames f, LATERAL (SELECT unnest(range(1, num_defects + 1)) AS i)),
 pointed AS (SELECT *, """ + _POINTS.format(hole="type = 'hole'", size="size_mm") + """ AS p FROM boxed),
 frames AS (SELECT f.*, CASE WHEN roll_id < 5 THEN score > 50 END AS is_defective, coalesce((SELECT sum(p) FROM pointed q WHERE q.frame_id = f.frame_id), 0) AS points FROM fx_frames f)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(i: Column) -> Column:
        size = F.round(F.col("score") * i, 1)
        kind = F.element_at(F.array(F.lit(None), F.lit("unknown"), F.lit("hole"), F.lit("stain")), ((F.col("frame_id") + i) % 4 + 1).cast("int"))
        return F.struct(kind.alias("type"), (((F.col("frame_id") * 7 + i) % 100) / 100.0).alias("conf"), size.alias("size_mm"), C.defect_points(size, kind == "hole").alias("points"), i.alias("ord"))

    rows = view(spark, sf_dir, "fx_frames")
    boxes = F.when(F.col("num_defects") > 0, F.transform(F.sequence(F.lit(1), F.col("num_defects")), box)).otherwise(F.array().cast("array<struct<type:string,conf:double,size_mm:double,points:int,ord:int>>"))
    rows = rows.withColumn("boxes", boxes).withColumn("threshold", F.when(F.col("roll_id") < 5, F.lit(50.0)))
    return rows.withColumns({"points": F.aggregate("boxes", F.lit(0), lambda a, b: a + b["points"]), "is_defective": C.verdict(F.col("score"), F.col("threshold"))})


_SIDE = "(224 / 5.0::DOUBLE)"


@query(with_views("fx_frames") + _FRAMES + f""", sums AS (SELECT roll_id, count(*) AS n_all, count(*) FILTER (NOT failed) AS n_done, coalesce(sum(points) FILTER (NOT failed), 0)::BIGINT AS points FROM frames GROUP BY roll_id),
 rated AS (SELECT *, points * 3600.0::DOUBLE / (n_all * {_SIDE} / 914.4::DOUBLE * ({_SIDE} / 25.4::DOUBLE)) AS pa, points * 3600.0::DOUBLE / (n_done * {_SIDE} / 914.4::DOUBLE * ({_SIDE} / 25.4::DOUBLE)) AS pd FROM sums)
 SELECT roll_id, n_all, n_done, points, floor(pa + 0.5)::BIGINT AS p100_all, CASE WHEN pa <= 40 THEN 'first' ELSE 'second' END AS grade_all, round(n_all * {_SIDE} / 914.4::DOUBLE * ({_SIDE} / 25.4::DOUBLE) / 36, 6) AS area_sqyd_all,
        floor(pd + 0.5)::BIGINT AS p100_done, CASE WHEN pd <= 40 THEN 'first' ELSE 'second' END AS grade_done, round(n_done * {_SIDE} / 914.4::DOUBLE * ({_SIDE} / 25.4::DOUBLE) / 36, 6) AS area_sqyd_done FROM rated""")
def batch_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.batch_grades(_frames(spark, sf_dir))


_SUMMARY = " SELECT roll_id, count(*) AS total, count(*) AS done, count(*) FILTER (NOT failed AND coalesce(is_defective, num_defects > 0)) AS defective, coalesce(sum(points) FILTER (NOT failed), 0)::BIGINT AS points, count(*) - count(*) FILTER (NOT failed AND coalesce(is_defective, num_defects > 0)) AS passed FROM frames GROUP BY roll_id"


@query(with_views("fx_frames") + _FRAMES + _SUMMARY)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.batch_summary(_frames(spark, sf_dir), "roll_id")


_LOG = """, bad AS (SELECT * FROM frames WHERE NOT failed AND coalesce(is_defective, num_defects > 0)),
 log AS (SELECT b.frame_id, CASE WHEN p.i IS NULL THEN 'unlocalized' WHEN type IS NULL THEN 'defect' WHEN type = 'unknown' THEN 'uncertain' ELSE type END AS type,
         size_mm, CASE WHEN p.i IS NULL THEN b.points ELSE p.p END::BIGINT AS points FROM bad b LEFT JOIN pointed p ON p.frame_id = b.frame_id)"""


@query(with_views("fx_frames") + _FRAMES + _LOG + " SELECT * FROM log")
def defect_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.defect_log(_frames(spark, sf_dir))


@query(with_views("fx_frames") + _FRAMES + _LOG + " SELECT type, count(*) AS n, sum(points)::BIGINT AS points FROM log GROUP BY type")
def defects_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.by_type(G.defect_log(_frames(spark, sf_dir)))


@query(with_views("fx_frames") + _FRAMES + " SELECT frame_id, arg_max(i, size_mm * 1000000 - i)::INT AS ord, max(size_mm) AS size_mm, sum(p)::BIGINT AS frame_points FROM pointed GROUP BY frame_id")
def main_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _frames(spark, sf_dir).select("frame_id", F.explode("boxes").alias("b")).select("frame_id", "b.*")
    return G.main_defect(boxes, "frame_id", area="size_mm").select("frame_id", "box.ord", "box.size_mm", "frame_points")


@query(with_views("fx_frames") + _FRAMES + " SELECT frame_id, i::INT AS ord, CASE WHEN type IS NULL THEN 'defect' WHEN type = 'unknown' THEN 'uncertain' ELSE type END AS shown, coalesce(type = 'unknown', false) OR conf < 0.6 AS is_uncertain FROM pointed")
def type_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _frames(spark, sf_dir).select("frame_id", F.explode("boxes").alias("b"))
    return boxes.select("frame_id", "b.ord", C.shown_type(F.col("b.type")).alias("shown"), C.uncertain(F.col("b.type"), F.col("b.conf")).alias("is_uncertain"))


@query(with_views("fx_images", "fx_frames") + " SELECT frame_id, threshold, score > threshold AS is_defective, coalesce(score > threshold, num_defects > 0) AS defective FROM (SELECT *, CASE WHEN roll_id < 3 THEN 10.0::DOUBLE WHEN roll_id < 6 THEN 50.0::DOUBLE END AS threshold FROM fx_frames)")
def threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    override, model = F.when(F.col("roll_id") < 3, F.lit(10.0)), F.when(F.col("roll_id") < 6, F.lit(50.0))
    rows = view(spark, sf_dir, "fx_frames").withColumn("threshold", F.coalesce(override, model))
    rows = rows.withColumn("is_defective", C.verdict(F.col("score"), F.col("threshold")))
    return rows.select("frame_id", "threshold", "is_defective", C.effective_verdict(F.col("is_defective"), F.col("num_defects")).alias("defective"))


@query(with_views("fx_proba") + """, top AS (SELECT *, greatest(p0, p1, p2) AS conf, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'hole' WHEN p1 >= p2 THEN 'stain' ELSE 'slub' END AS name FROM fx_proba)
 SELECT id, name AS type, CASE WHEN conf < 0.6 THEN 'unknown' ELSE name END AS type_or_unknown, floor(conf * 100 + 0.5::DOUBLE) / 100 AS conf, count(*) AS n FROM top GROUP BY ALL""")
def predict_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    proba = F.array("p0", "p1", "p2")
    (plain, conf), (kept, _) = predicted_type(proba, KINDS), predicted_type(proba, KINDS, 0.6)
    return view(spark, sf_dir, "fx_proba").select("id", plain.alias("type"), kept.alias("type_or_unknown"), conf.alias("conf")).groupBy("id", "type", "type_or_unknown", "conf").agg(F.count(F.lit(1)).alias("n"))


_CATALOG = ", catalog AS (SELECT path, split_part(path, '/', 3) AS category, split_part(path, '/', 4) AS split, split_part(path, '/', 5) AS defect_type, replace(split_part(path, '/', 6), '.png', '') AS stem FROM fx_catalog), labelled AS (SELECT *, (defect_type <> 'good')::INT AS label FROM catalog)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.catalog_columns(view(spark, sf_dir, "fx_catalog"))


@query(with_views("fx_catalog") + _CATALOG + " SELECT * FROM labelled")
def image_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir)


@query(with_views("fx_catalog") + _CATALOG + " SELECT DISTINCT category FROM labelled WHERE split = 'train' AND defect_type = 'good'")
def discover_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_categories(_catalog(spark, sf_dir), "all")


@query(with_views("fx_catalog") + _CATALOG + ", masks AS (SELECT category, defect_type, stem, length(stem) * 10 AS mask_pixels FROM labelled WHERE label = 1 AND stem LIKE '%1') SELECT l.*, m.mask_pixels IS NOT NULL AS has_mask, coalesce(m.mask_pixels, 0) AS mask_pixels FROM labelled l LEFT JOIN masks m ON l.category = m.category AND l.defect_type = m.defect_type AND l.stem = m.stem")
def attach_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _catalog(spark, sf_dir)
    masks = images.where((F.col("label") == 1) & F.col("stem").endswith("1")).select("category", "defect_type", "stem", (F.length("stem") * 10).alias("mask_pixels"))
    return S.attach_masks(images, masks)


_TILES = ", tiles AS (SELECT *, unnest(range(0, width_px - 255, 256)) AS x0 FROM fx_strips), named AS (SELECT *, x0 // 256 AS tile_idx, roll || '_' || strip || '_t' || lpad((x0 // 256)::VARCHAR, 2, '0') AS name, roll || '_' || strip AS grp FROM tiles)"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.tiles(view(spark, sf_dir, "fx_strips"))
    return rows.withColumn("name", S.tile_name(F.col("roll"), F.col("strip"), F.col("tile_idx"))).withColumn("grp", S.group_of(F.col("name")))


@query(with_views("fx_strips") + _TILES + " SELECT roll, strip, tile_idx, x0, least(height_px, 256) AS h, name FROM named")
def tile_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("roll", "strip", "tile_idx", "x0", "h", "name")


@query(with_views("fx_strips") + _TILES + " SELECT grp, roll, count(*) AS n FROM named GROUP BY ALL")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).groupBy("grp", "roll").agg(F.count(F.lit(1)).alias("n"))


_BY_GROUP = ", counts AS (SELECT grp, count(*) AS n, md5('{seed}|' || grp) AS h FROM {rows} GROUP BY grp), cum AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM counts), tr AS (SELECT coalesce(sum(n), 0) AS t FROM cum WHERE c < {train}), dealt AS (SELECT grp, n, CASE WHEN c < {train} THEN 'train' WHEN c - t < {test} THEN 'test' END AS split FROM cum, tr)"


@query(with_views("fx_strips") + _TILES + _BY_GROUP.format(seed=0, rows="named", train=700, test=150) + " SELECT * FROM dealt WHERE split IS NOT NULL")
def split_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_by_group(_tiles(spark, sf_dir), "grp", 700, 150)


_BY_TILE = ", ordered AS (SELECT name, grp, row_number() OVER (ORDER BY md5('0|' || name), name) AS no FROM named), leaky AS (SELECT name, grp, CASE WHEN no <= 700 THEN 'train' ELSE 'test' END AS split FROM ordered WHERE no <= 850)"


@query(with_views("fx_strips") + _TILES + _BY_TILE + " SELECT name, split FROM leaky")
def split_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_by_tile(_tiles(spark, sf_dir), "name", 700, 150)


_LEAK = "SELECT '{0}' AS method, count(*) FILTER (tr) AS train_groups, count(*) FILTER (te) AS test_groups, count(*) FILTER (tr AND te) AS shared_groups, round(count(*) FILTER (tr AND te) / count(*) FILTER (te), 6) AS leak_share FROM (SELECT grp, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te FROM {1} GROUP BY grp)"


@query(with_views("fx_strips") + _TILES + _BY_TILE + _BY_GROUP.format(seed=0, rows="named", train=700, test=150) + " " + _LEAK.format("tile", "leaky") + " UNION ALL " + _LEAK.format("group", "(SELECT * FROM dealt WHERE split IS NOT NULL)"))
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tiles(spark, sf_dir)
    leaky = S.split_by_tile(tiles, "name", 700, 150).withColumn("grp", S.group_of(F.col("name")))
    grouped = S.split_by_group(tiles, "grp", 700, 150)
    found = S.leakage(leaky, "grp").withColumn("method", F.lit("tile")).unionByName(S.leakage(grouped, "grp").withColumn("method", F.lit("group")))
    return found.withColumn("leak_share", F.round("leak_share", 6))


@query(with_views("fx_strips") + _TILES + ", before AS (SELECT *, (tile_idx % 5 = 4)::INT AS label, CASE WHEN tile_idx % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM named), normal AS (SELECT * FROM before WHERE label = 0)" + _BY_GROUP.format(seed=0, rows="normal", train=700, test=150) + " SELECT n.name, d.split, n.label FROM normal n JOIN dealt d ON n.grp = d.grp WHERE d.split IS NOT NULL UNION ALL SELECT name, split, label FROM before WHERE label <> 0")
def regroup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tiles(spark, sf_dir).withColumns({"label": (F.col("tile_idx") % 5 == 4).cast("int"), "split": F.when(F.col("tile_idx") % 2 == 0, "train").otherwise("test")})
    return S.regroup(tiles, 700, 150)


@query(with_views("fx_pixels") + " SELECT image_id, y // 4 AS tile_y, x // 4 AS tile_x, count(*) AS n_defect FROM fx_pixels WHERE gt > 0 AND image_id % 10 <> 9 GROUP BY ALL")
def defect_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = view(spark, sf_dir, "fx_pixels")
    masked = pixels.select("image_id").distinct().where("image_id % 10 <> 9")
    return S.defect_tiles(pixels, masked, 4)


@query(with_views("fx_uploads") + """ SELECT upload_id, category, CASE WHEN category = 'denim' THEN 404 WHEN category = 'aitex' THEN 503 WHEN length(payload) = 0 THEN 400 WHEN octet_length(encode(payload)) > 15000 THEN 413 WHEN upload_id % 13 = 5 THEN 400 ELSE 200 END AS status,
  CASE WHEN category = 'denim' THEN 'unknown category' WHEN category = 'aitex' THEN 'model not loadable' WHEN length(payload) = 0 THEN 'empty payload' WHEN octet_length(encode(payload)) > 15000 THEN 'too large' WHEN upload_id % 13 = 5 THEN 'not decodable' END AS reason FROM fx_uploads""")
def validate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(c,) for c in ("carpet", "leather", "grid", "aitex")], "category string")
    models = spark.createDataFrame([(c,) for c in ("carpet", "leather", "grid")], "category string")
    return S.validate_uploads(view(spark, sf_dir, "fx_uploads"), known, models, 15000, decodable=F.col("upload_id") % 13 != 5).select("upload_id", "category", "status", "reason")


@query(with_views("fx_runs") + " SELECT category, layer_set, round(pro, 6) AS pro, n_test, NULL::DOUBLE AS eval_sec FROM fx_runs UNION ALL SELECT category, 'extra', round(max(pro), 6), sum(n_test)::BIGINT, 1.5::DOUBLE FROM fx_runs GROUP BY category")
def append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a stored log, the second with a column more."""
    log = view(spark, sf_dir, "fx_runs").withColumn("pro", F.round("pro", 6))
    new = log.groupBy("category").agg(F.max("pro").alias("pro"), F.sum("n_test").alias("n_test")).withColumns({"layer_set": F.lit("extra"), "eval_sec": F.lit(1.5)})
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    T.append_log(log, path)
    T.append_log(new.select("category", "layer_set", "pro", "n_test", "eval_sec"), path)
    return T.read_log(spark, path).drop("append")


@query(with_views("fx_runs") + " SELECT category, layer_set, CASE WHEN layer_set = 'F' THEN 0.05 ELSE 0.1 END::DOUBLE AS coreset_ratio, 1 AS n_neighbors FROM (SELECT DISTINCT category FROM fx_runs), (SELECT DISTINCT layer_set FROM fx_runs)")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "fx_runs")
    layers = runs.select("layer_set").distinct().withColumn("coreset_ratio", F.when(F.col("layer_set") == "F", F.lit(0.05)))
    return T.sweep_grid(runs.select("category").distinct(), layers, {"coreset_ratio": 0.1, "n_neighbors": 1}).drop("config_id")


@query(with_views("fx_runs") + " SELECT category, layer_set, n_test, round(n_test / 7.0::DOUBLE / greatest(n_test, 1) * 1000, 2) AS latency_ms_per_img FROM fx_runs")
def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "fx_runs").withColumn("eval_sec", F.col("n_test") / 7.0)
    return E.run_latency(runs).select("category", "layer_set", "n_test", "latency_ms_per_img")


@query(with_views("fx_runs") + ", base AS (SELECT category, pro AS base_pro FROM fx_runs WHERE layer_set = 'F') SELECT r.category, arg_max(layer_set, pro) AS best_layer, round(max(pro), 6) AS best_pro, round(any_value(base_pro), 6) AS base_pro, round((max(pro) - any_value(base_pro)) / any_value(base_pro) * 100, 4) AS gain_percent FROM fx_runs r LEFT JOIN base b ON r.category = b.category GROUP BY r.category")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.compare_runs(view(spark, sf_dir, "fx_runs"), "F")
    return found.select("category", "best_layer", F.round("best_pro", 6).alias("best_pro"), F.round("base_pro", 6).alias("base_pro"), F.round("gain_percent", 4).alias("gain_percent"))
