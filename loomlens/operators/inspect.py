"""From raw anomaly maps to frame results and graded rolls: the single steps put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomlens.functions import columns as C
from loomlens.operators import grading as G
from loomlens.operators import localize as L
from loomlens.operators import packed as K
from loomlens.operators import typing_probe as Y


def boxed_maps(frames: DataFrame, maps: DataFrame, models: DataFrame, image_size: int, k: float = 2.0, min_area: int = 64) -> DataFrame:
    """frames with threshold, score and boxes (an array; null without a map): each map is scaled by the bounds of its
    category's model, or by its own, and its boxes are found where it lies. maps: (image_id, score: packed)."""
    own = frames.join(maps.select("image_id", F.col("score").alias("_map")), "image_id", "left").join(models.select("category", "threshold", "vmin", "vmax"), "category", "left")
    scaled = own.withColumns({"score": K.peak("_map"), "_scaled": K.scaled("_map", F.col("vmin"), F.col("vmax"))})
    return scaled.withColumn("boxes", K.boxes("_scaled", image_size, image_size, k, min_area)).drop("_map", "_scaled", "vmin", "vmax")


def packed_maps(cells: DataFrame, image_size: int) -> DataFrame:
    """(image_id, score: packed) of raw maps, whether they come packed or as a row a cell."""
    return cells if isinstance(cells.schema["score"].dataType, ArrayType) else K.pack(cells, image_size, image_size)


def frame_boxes(frames: DataFrame, cells: DataFrame, models: DataFrame, k: float = 2.0, min_area: int = 64, image_size: int | None = None) -> DataFrame:
    """(image_id, x, y, w, h, area, score): boxes of the adaptive mask on normalised maps. Without image_size, cells
    must come as rows; the side is then one more than their largest y or x."""
    if image_size is None:
        image_size = (cells.select(F.max(F.greatest("y", "x"))).first()[0] or 0) + 1
    found = boxed_maps(frames.select("image_id", "category"), packed_maps(cells, image_size), models, image_size, k, min_area)
    box = found.select("image_id", F.explode("boxes").alias("b"))
    return box.select("image_id", "b.x", "b.y", "b.w", "b.h", "b.area", F.round("b.score", 4).alias("score"))


def typed_boxes(boxes: DataFrame, features: DataFrame, model, labels: Sequence[str], image_size: int, grid: int, threshold: float | None = None) -> DataFrame:
    """boxes with type and type_conf: the estimator on the mean feature of the grid cells that a box touches.

    features: (image_id, row_id, col_id, feature); model: a fitted probe, or whatever gives rows with `features` a column
    proba by transform(rows), such as a calibrated probe or the probes of all categories, if boxes have their columns."""
    names = boxes.columns
    touched = L.grid_cells(boxes, image_size, grid, grid).join(features.select("image_id", F.col("row_id").alias("gy"), F.col("col_id").alias("gx"), "feature"), ["image_id", "gy", "gx"])
    pooled = touched.groupBy(*names).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("feature").cast("array<double>")))).alias("features"))
    kind, conf = Y.predicted_type(F.col("proba"), labels, threshold)
    scored = Y.probabilities(model, pooled) if isinstance(model, PipelineModel) else model.transform(pooled)
    return scored.select(*names, kind.alias("type"), conf.alias("type_conf"))


def frame_results(frames: DataFrame, cells: DataFrame, models: DataFrame, *, image_size: int, ppm: float = 5.0, k: float = 2.0, min_area: int = 64, types: DataFrame | None = None) -> DataFrame:
    """One row per frame: category, anomaly_score (4 digits), threshold, is_defective (null without a threshold),
    num_defects, boxes, defect_points, pixels_per_mm, image_size and original_size.

    frames: (image_id, category, width, height, and ppm, null or not above 0 for the default); cells: raw maps of image_size
    a side, (image_id, score: packed) or (image_id, y, x, score); models: (category, threshold, vmin, vmax), a row per category;
    types: boxes with type and type_conf, from typed_boxes. Boxes are in reading order, each with its size in mm
    (1 digit), points, and its place in the original picture (ox, oy, ow, oh). A frame without a map has no score.
    """
    scale = F.when(F.col("ppm") > 0, F.col("ppm")).otherwise(F.lit(float(ppm)))
    own = frames.select("image_id", "category", "width", "height", scale.alias("pixels_per_mm"))
    found = boxed_maps(own, packed_maps(cells, image_size), models, image_size, k, min_area)
    place = ["y", "x", "w", "h", "area"]
    if types is None:
        found = found.withColumn("_types", F.lit(None).cast("array<struct<y: long, x: long, w: long, h: long, area: long, type: string, type_conf: double>>"))
    else:
        named = F.struct(*[F.col(c).cast("long").alias(c) for c in place], "type", "type_conf")
        found = found.join(types.groupBy("image_id").agg(F.collect_list(named).alias("_types")), "image_id", "left")

    def full(b: Column) -> Column:
        size = F.round(C.size_mm(b["w"], b["h"], F.col("pixels_per_mm")), 1)
        onto = lambda c, side: F.floor(b[c] * F.col(side) / image_size)
        kind = F.get(F.filter("_types", lambda t: F.struct(*[t[c] for c in place]) == F.struct(*[b[c] for c in place])), F.lit(0))
        return F.struct(
            *[b[c].alias(c) for c in place], F.round(b["score"], 4).alias("score"), size.alias("size_mm"), C.defect_points(size, F.lit(False)).alias("points"), kind["type"].alias("type"), kind["type_conf"].alias("type_conf"),
            onto("x", "width").alias("ox"), onto("y", "height").alias("oy"), onto("w", "width").alias("ow"), onto("h", "height").alias("oh"),
        )

    found = found.withColumn("boxes", F.transform(F.coalesce("boxes", F.array().cast(f"array<{K.BOX}>")), full))
    return found.select(
        "image_id", "category", F.round("score", 4).alias("anomaly_score"), C.verdict(F.col("score"), F.col("threshold")).alias("is_defective"), F.round("threshold", 4).alias("threshold"),
        F.size("boxes").alias("num_defects"), "boxes", F.aggregate("boxes", F.lit(0).cast("long"), lambda n, b: n + b["points"]).alias("defect_points"),
        "pixels_per_mm", F.lit(image_size).alias("image_size"), F.array("width", "height").alias("original_size"),
    )


def strip_windows(strips: DataFrame, window: int = 256) -> DataFrame:
    """(roll_id, tile_idx, x0, window, length_px, width_px) of strips (roll_id, width_px: along the roll, height_px):
    whole windows as wide as the strip is high, at most `window`."""
    side = F.least(F.lit(window).cast("long"), F.col("height_px").cast("long"))
    found = strips.withColumn("window", side)
    starts = F.when(F.col("width_px") >= side, F.sequence(F.lit(0).cast("long"), F.col("width_px").cast("long") - side, side))
    rows = found.select("roll_id", F.col("width_px").alias("length_px"), F.col("height_px").alias("width_px"), "window", F.posexplode(starts).alias("tile_idx", "x0"))
    return rows.select("roll_id", "tile_idx", "x0", "window", "length_px", "width_px")


def scan_rolls(strips: DataFrame, windows: DataFrame, cells: DataFrame, models: DataFrame, *, image_size: int, ppm: float = 5.0, k: float = 2.0, min_area: int = 64, tolerance: float = C.TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(defects, grades) of whole strips. strips: (roll_id, width_px, height_px); windows: those of strip_windows with
    image_id and category; cells: the windows' raw maps. Boxes are moved to the strip's pixels and sized there."""
    boxes = frame_boxes(windows, cells, models, k, min_area, image_size)
    placed = G.located(boxes.join(windows.select("image_id", "roll_id", "x0", "window"), "image_id"), F.col("x0"), F.col("window"), image_size)
    size = C.size_mm(F.col("w_px"), F.col("h_px"), F.lit(float(ppm)))
    defects = placed.select(
        "roll_id", F.round(F.col("x_px") / ppm, 1).alias("pos_mm"), F.round(size, 1).alias("size_mm"), C.defect_points(size, F.lit(False)).alias("points"),
        F.col("x_px").alias("x"), F.col("y_px").alias("y"), F.col("w_px").alias("w"), F.col("h_px").alias("h"),
    )
    rolls = strips.select("roll_id", (F.col("width_px") / ppm).alias("length_mm"), (F.col("height_px") / ppm).alias("width_mm"))
    # The grade counts points of the rounded sizes.
    counted = defects.withColumn("points", C.defect_points(F.col("size_mm"), F.lit(False)))
    return defects, G.roll_grades(rolls, counted, tolerance)
