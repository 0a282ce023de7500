"""Roll and batch grading, defect logs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.functions import columns as C


def sized(defects: DataFrame, round_first: bool = False) -> DataFrame:
    """Add size_mm and points; with round_first the size is rounded to 0.1 mm before its points."""
    size = C.size_mm(F.col("w_px"), F.col("h_px"), F.col("ppm"))
    return defects.withColumn("size_mm", F.round(size, 1) if round_first else size).withColumn("points", C.defect_points(F.col("size_mm"), F.col("is_hole")))


def roll_grades(rolls: DataFrame, defects: DataFrame, tolerance: float = C.TOLERANCE) -> DataFrame:
    """One row per roll, also those without a defect: points, count, sizes, p100 and grade.

    Defects are summed before the join, so the join has one row per roll on either side. The grade is
    taken before p100 is rounded.
    """
    sums = defects.groupBy("roll_id").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("n"))
    yd, inch = F.col("length_mm") / C.MM_PER_YARD, F.col("width_mm") / C.MM_PER_INCH
    total = F.coalesce(F.col("points"), F.lit(0)).cast("long")
    p100 = C.points_per_100sqyd(total, yd, inch)
    return rolls.join(sums, "roll_id", "left").select(
        "roll_id", total.alias("total_points"), F.coalesce("n", F.lit(0)).alias("n_defects"), F.round(yd, 3).alias("length_yd"),
        F.round(inch, 2).alias("width_in"), F.round(p100, 2).alias("p100"), C.grade(p100, tolerance).alias("grade"),
    )


def located(defects: DataFrame, tile_x0: Column, window: Column, image_size: int) -> DataFrame:
    """Boxes of scored windows in roll pixels: x = x0 + trunc(box x * scale), sizes scaled too."""
    scale = window / F.lit(float(image_size))
    at = lambda c: (F.col(c) * scale).cast("long")
    return defects.withColumns({"x_px": tile_x0 + at("x"), "y_px": at("y"), "w_px": at("w"), "h_px": at("h")})


def batch_grades(frames: DataFrame, image_size: int = 224, ppm: float = 5.0, tolerance: float = C.TOLERANCE) -> DataFrame:
    """From rows (roll_id, points, failed) per frame: grades over all frames and over successes only.

    Frames are squares stacked along the roll; p100 is rounded half up to an integer.
    """
    sums = frames.groupBy("roll_id").agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.when(~F.col("failed"), 1).otherwise(0)).alias("n_done"), F.sum(F.when(~F.col("failed"), F.col("points")).otherwise(0)).alias("points"))
    side_mm = image_size / ppm
    out = sums
    for name, n in (("all", F.col("n_all")), ("done", F.col("n_done"))):
        length, width = n * F.lit(side_mm) / C.MM_PER_YARD, F.lit(side_mm / C.MM_PER_INCH)
        p100 = C.points_per_100sqyd(F.col("points"), length, width)
        out = out.withColumns({f"p100_{name}": F.floor(p100 + 0.5), f"grade_{name}": C.grade(p100, tolerance), f"area_sqyd_{name}": F.round(length * width / 36, 6)})
    return out


def batch_summary(frames: DataFrame, *group: str) -> DataFrame:
    """done, total, defective, passed (failures count as passed) and points of each batch."""
    bad = C.effective_verdict(F.col("is_defective"), F.col("num_defects"))
    ok = ~F.col("failed")
    sums = frames.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.lit(1)).alias("done"),
        F.sum(F.when(ok & bad, 1).otherwise(0)).alias("defective"), F.sum(F.when(ok, F.col("points")).otherwise(0)).alias("points"),
    )
    return sums.withColumn("passed", F.greatest(F.lit(0), F.col("done") - F.col("defective")))


def defect_log(frames: DataFrame) -> DataFrame:
    """Rows for defective frames: one per box (struct type, size_mm, points), or one 'unlocalized'."""
    bad = ~F.col("failed") & C.effective_verdict(F.col("is_defective"), F.col("num_defects"))
    rows = frames.where(bad).select("frame_id", "points", F.explode_outer("boxes").alias("box"))
    none = F.col("box").isNull()
    return rows.select("frame_id", F.when(none, "unlocalized").otherwise(C.shown_type(F.col("box.type"))).alias("type"), F.when(~none, F.col("box.size_mm")).alias("size_mm"), F.when(none, F.coalesce("points", F.lit(0))).otherwise(F.coalesce("box.points", F.lit(0))).cast("long").alias("points"))


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points")).orderBy(F.desc("points"), "type")


def main_defect(boxes: DataFrame, *frame: str, area: str = "area", order: str = "ord") -> DataFrame:
    """The largest box of each frame (the first on ties) and the sum of its boxes' points."""
    best = F.max_by(F.struct(*[c for c in boxes.columns if c not in frame]), F.struct(F.col(area), -F.col(order)))
    return boxes.groupBy(*frame).agg(best.alias("box"), F.sum("points").alias("frame_points"))


def most_anomalous(scores: DataFrame, n: int = 6) -> DataFrame:
    return scores.orderBy(F.desc("score"), "image_id").limit(n)


def most_anomalous_by(scores: DataFrame, group: str, n: int = 6) -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "image_id")))
    return ranked.where(F.col("rank") <= n)
