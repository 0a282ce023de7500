"""From anomaly maps to regions and boxes, and how well boxes cover ground truth.

Connected components run per image (one raster in a task at a time) or, for rasters of any width, over
runs of pixels with joins. Box coverage is an equi join on cells, never a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adaptive_mask(cells: DataFrame, k: float = 2.0, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Cells at or above mean + k standard deviations (population) of their image; none if it is flat."""
    stats = cells.groupBy(*keys).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    on = (F.col("_s") >= 1e-6) & (F.col("score") >= F.col("_m") + k * F.col("_s"))
    return cells.join(stats, list(keys)).where(on).drop("_m", "_s")


def fixed_mask(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    return cells.where(F.col("score") >= threshold)


def flood_share(cells: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg((F.col("score") >= threshold).cast("double")).alias("flood_share"))


def _label(y: np.ndarray, x: np.ndarray, diagonal: bool) -> np.ndarray:
    """The smallest index (in reading order of the sorted cells) in each cell's component.

    Cells of a row that touch form a run; runs of neighbouring rows that touch are found by binary search, and
    the smallest label of the runs passes over them until nothing changes, each round also to the label's label.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    new = np.append(True, (np.diff(y) != 0) | (np.diff(x) != 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(y)) - 1
    slack = 1 if diagonal else 0
    wide = int(x.max() - x.min()) + 4
    place = lambda row, col: row * wide + (col - x.min()) + 1
    low = np.searchsorted(place(y[last], x[last]), place(y[first] + 1, x[first] - slack))
    high = np.searchsorted(place(y[first], x[first]), place(y[first] + 1, x[last] + slack), side="right")
    touching = np.maximum(0, high - low)
    a = np.repeat(np.arange(len(first)), touching)
    b = np.repeat(low - (np.cumsum(touching) - touching), touching) + np.arange(len(a))
    label = np.arange(len(first))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(after, side, least)
        after = after[after]
        if (after == label).all():
            return first[label][np.cumsum(new) - 1]
        label = after


def components(cells: DataFrame, connectivity: int, key: str = "image_id", value: str = "score") -> DataFrame:
    """Add comp to the (key, y, x, value) of foreground cells: first_y * 2^31 + first_x of its region."""
    diagonal = connectivity == 8

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        first = _label(y, x, diagonal)
        return table.append_column("comp", pa.array(y[first] * (1 << 31) + x[first], pa.int64()))

    kind = cells.schema[key].dataType.simpleString()
    own = cells.select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias(value))
    return own.groupBy(key).applyInArrow(run, f"{key} {kind}, y long, x long, {value} double, comp long")


def components_by_runs(cells: DataFrame, connectivity: int, key: str = "image_id") -> DataFrame:
    """As components, by joins alone: runs of a row's cells, edges between touching runs of
    neighbouring rows, then smallest labels until nothing changes. For rasters that no task should hold."""
    from loomlens.operators.graph import connected

    row = Window.partitionBy(key, "y").orderBy("x")
    runs = cells.select(key, "y", "x").withColumn("_g", F.col("x") - F.row_number().over(row)).groupBy(key, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = runs.withColumn("run", F.struct(F.col(key), F.col("y"), F.col("x0")))
    slack = 1 if connectivity == 8 else 0
    below = runs.select(key, (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("run").alias("b"))
    edges = runs.join(below.hint("merge"), [key, "y"]).where((F.col("bx0") <= F.col("x1") + slack) & (F.col("bx1") >= F.col("x0") - slack)).select(F.col("run").alias("a"), "b")
    labels = connected(runs.select(F.col("run").alias("node")), edges)
    placed = runs.join(labels.hint("merge"), runs["run"] == labels["node"]).select(key, "y", F.explode(F.sequence("x0", "x1")).alias("x"), (F.col("component.y") * F.lit(1 << 31) + F.col("component.x0")).alias("comp"))
    return placed


def boxes(comps: DataFrame, min_area: int = 64, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, x, y, w, h, area, score) of each component of at least min_area cells; score is its peak."""
    return (
        comps.groupBy(*keys, "comp")
        .agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count(F.lit(1)).alias("area"), F.round(F.max("score"), 4).alias("score"))
        .where(F.col("area") >= min_area)
        .drop("comp")
    )


def covered(boxes_of: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The distinct cells (keys, y, x) inside any box, ends excluded."""
    rows = boxes_of.where((F.col("w") > 0) & (F.col("h") > 0)).withColumn("py", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    return rows.select(*keys, F.col("py").alias("y"), F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("x")).distinct()


def overlap_areas(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, area_first, area_second, area_both) of the union of each side's boxes (keys, x, y, w, h), by sweep lines.

    Box sides cut an image into vertical strips; in each, running sums over the boxes' ends give how many boxes of
    either side lie at a height. Work grows with the boxes and the strips that they cross, not with pixels, and sides may be
    fractions. Images without a box of either side give no row; empty boxes, and boxes with a null, don't count.
    """
    keys = list(keys)
    side_of = lambda boxes_of, a, b: boxes_of.select(*keys, "x", "y", (F.col("x") + F.col("w")).alias("_x1"), (F.col("y") + F.col("h")).alias("_y1"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    own = side_of(first, 1, 0).unionByName(side_of(second, 0, 1)).where((F.col("_x1") > F.col("x")) & (F.col("_y1") > F.col("y")))
    across = Window.partitionBy(*keys).orderBy("_side")
    strips = own.select(*keys, F.explode(F.array("x", "_x1")).alias("_side")).distinct().withColumns({"_strip": F.row_number().over(across), "_wide": F.lead("_side").over(across) - F.col("_side")})
    numbered = lambda side, name: strips.select(*keys, F.col("_side").alias(side), F.col("_strip").alias(name))
    crossed = own.join(numbered("x", "_i0"), [*keys, "x"]).join(numbered("_x1", "_i1"), [*keys, "_x1"]).withColumn("_strip", F.explode(F.sequence(F.col("_i0"), F.col("_i1") - 1)))
    end = lambda at, sign: F.struct(F.col(at).alias("at"), (sign * F.col("_a")).alias("a"), (sign * F.col("_b")).alias("b"))
    ends = crossed.select(*keys, "_strip", F.explode(F.array(end("y", 1), end("_y1", -1))).alias("_e")).groupBy(*keys, "_strip", "_e.at").agg(F.sum("_e.a").alias("_da"), F.sum("_e.b").alias("_db"))
    up = Window.partitionBy(*keys, "_strip").orderBy("at")
    spans = ends.select(*keys, "_strip", (F.lead("at").over(up) - F.col("at")).alias("_high"), (F.sum("_da").over(up) > 0).alias("_in_a"), (F.sum("_db").over(up) > 0).alias("_in_b")).where("_in_a or _in_b")
    covered_by = lambda on: F.coalesce(F.sum(F.when(on, F.col("_high") * F.col("_wide"))), F.lit(0))
    a, b = F.col("_in_a"), F.col("_in_b")
    return spans.join(strips.drop("_side"), [*keys, "_strip"]).groupBy(*keys).agg(covered_by(a).alias("area_first"), covered_by(b).alias("area_second"), covered_by(a & b).alias("area_both"))


def grid_cells(boxes_of: DataFrame, size: int, gh: int, gw: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Add the feature-grid cells (gy, gx) each box touches, one at least."""
    low = lambda c, n: F.floor(F.col(c) * n / size)
    high = lambda c, d, n: F.greatest(low(c, n) + 1, F.floor((F.col(c) + F.col(d)) * n / size))
    return boxes_of.withColumn("gy", F.explode(F.sequence(low("y", gh), high("y", "h", gh) - 1))).withColumn("gx", F.explode(F.sequence(low("x", gw), high("x", "w", gw) - 1)))


def localization_quality(cells: DataFrame, predicted: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Per method: means of IoU, precision and recall over images with ground truth, F1 of the means,
    shares of images with IoU of at least 0.5 and 0.75.

    cells: (image_id, y, x, gt) of all images; predicted: (method, image_id, y, x), distinct.
    """
    truth = cells.where("gt = 1").select("image_id", "y", "x")
    n_gt = truth.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = predicted.groupBy(*by, "image_id").agg(F.count(F.lit(1)).alias("n_pred"))
    both = predicted.join(truth, ["image_id", "y", "x"]).groupBy(*by, "image_id").agg(F.count(F.lit(1)).alias("n_both"))
    methods = predicted.select(*by).distinct()
    images = n_gt.withColumn("_1", F.lit(1)).join(F.broadcast(methods.withColumn("_1", F.lit(1))), "_1").drop("_1")
    rows = images.join(n_pred, [*by, "image_id"], "left").join(both, [*by, "image_id"], "left").fillna(0, ["n_pred", "n_both"])
    iou = F.col("n_both") / (F.col("n_gt") + F.col("n_pred") - F.col("n_both"))
    precision = F.coalesce(F.try_divide("n_both", "n_pred"), F.lit(0.0))
    sums = rows.select(*by, iou.alias("iou"), precision.alias("p"), (F.col("n_both") / F.col("n_gt")).alias("r")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"), F.avg("iou").alias("iou"), F.avg("p").alias("precision"), F.avg("r").alias("recall"),
        F.avg((F.col("iou") >= 0.5).cast("double")).alias("iou_50"), F.avg((F.col("iou") >= 0.75).cast("double")).alias("iou_75"),
    )
    p, r = F.col("precision"), F.col("recall")
    return sums.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def size_bins(regions: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Add bin to (area): small below the 33rd percentile, medium below the 67th, else large."""
    if low is None or high is None:
        from loomlens.operators.ranking import exact_percentiles

        edges = exact_percentiles(regions, [], (0.33, 0.67), "area").withColumnsRenamed({"q0": "_lo", "q1": "_hi"})
    else:
        edges = regions.sparkSession.createDataFrame([(float(low), float(high))], "_lo double, _hi double")
    name = F.when(F.col("area") < F.col("_lo"), "small").when(F.col("area") < F.col("_hi"), "medium").otherwise("large")
    return regions.join(F.broadcast(edges)).withColumn("bin", name).drop("_lo", "_hi")


def quality_by_size(cells: DataFrame, regions: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per size bin: regions, mean recall, share detected (recall of at least 0.5) and average precision
    of the bin's pixels against all normal pixels of images with a defect.

    cells: (image_id, y, x, score, gt); regions: (image_id, y, x, score, comp); predicted: (image_id, y, x).
    """
    from loomlens.operators import ranking as R

    hit = predicted.select("image_id", "y", "x", F.lit(1).alias("hit"))
    per = regions.join(hit, ["image_id", "y", "x"], "left").groupBy("image_id", "comp").agg(F.count(F.lit(1)).alias("area"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
    binned = size_bins(per)
    quality = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("mean_recall"), F.avg((F.col("recall") >= 0.5).cast("double")).alias("detected"))
    positive = regions.join(binned.select("image_id", "comp", "bin"), ["image_id", "comp"]).select("bin", "score", F.lit(1).alias("label"))
    defective = cells.where("gt = 1").select("image_id").distinct()
    normal = cells.where("gt = 0").join(defective, "image_id", "left_semi").select(F.explode(F.array(F.lit("small"), F.lit("medium"), F.lit("large"))).alias("bin"), "score", F.lit(0).alias("label"))
    ap = R.auroc_ap(R.cumulative(R.score_counts(positive.unionByName(normal), ["bin"]), ["bin"]), ["bin"]).select("bin", F.col("ap").alias("pixel_ap"))
    return quality.join(ap, "bin")


def overlap_score(cells: DataFrame, regions: DataFrame, thresholds: int = 200, limit: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """PRO, per `by` if given: mean share of each region covered against the false positive rate,
    integrated to `limit`.

    Each pixel is put once into a bucket of the evenly spaced thresholds, so one scan serves them all. Null
    without a region. Points with equal rates are ordered by overlap.
    """
    last, by = thresholds - 1, list(by)
    ends = cells.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_if(F.col("gt") == 0).alias("n_normal"))
    at = lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / last)

    def beside(rows: DataFrame, few: DataFrame) -> DataFrame:
        """rows with the columns of a table of one row per `by`."""
        return rows.join(few, by, "left") if by else rows.join(F.broadcast(few))

    def bucket(rows: DataFrame) -> DataFrame:
        guess = F.coalesce(F.floor(F.try_divide((F.col("score") - F.col("lo")) * last, F.col("hi") - F.col("lo"))), F.lit(last)).cast("long")
        rows = beside(rows, ends).withColumn("_g", F.greatest(F.lit(0), F.least(F.lit(last), guess)))
        exact = F.when((F.col("_g") < last) & (at(F.col("_g") + 1) <= F.col("score")), F.col("_g") + 1).when((F.col("_g") > 0) & (at(F.col("_g")) > F.col("score")), F.col("_g") - 1).otherwise(F.col("_g"))
        # The last threshold is the maximum itself.
        return rows.withColumn("bucket", F.when(F.col("score") >= F.col("hi"), F.lit(last)).otherwise(F.least(exact, F.lit(last - 1))))

    areas = regions.groupBy(*by, "image_id", "comp").agg(F.count(F.lit(1)).alias("area"))
    n_regions = areas.groupBy(*by).agg(F.count(F.lit(1)).alias("n_regions"))
    inside = bucket(regions).groupBy(*by, "image_id", "comp", "bucket").agg(F.count(F.lit(1)).alias("k")).join(areas, [*by, "image_id", "comp"]).groupBy(*by, "bucket").agg(F.sum(F.col("k") / (F.col("area") + 1e-8)).alias("overlap"))
    outside = bucket(cells.where("gt = 0")).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("fp"))
    steps = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bucket"), "n_normal")
    down = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)  # `thresholds` rows
    curve = beside(steps.join(inside, [*by, "bucket"], "left").join(outside, [*by, "bucket"], "left"), n_regions)
    curve = curve.select(*by, (F.sum(F.coalesce("fp", F.lit(0))).over(down) / (F.col("n_normal") + 1e-8)).alias("fpr"), (F.sum(F.coalesce("overlap", F.lit(0.0))).over(down) / F.nullif("n_regions", F.lit(0))).alias("pro"))
    order = Window.partitionBy(*by).orderBy("fpr", "pro")
    linked = curve.withColumns({"f0": F.lag("fpr").over(order), "p0": F.lag("pro").over(order), "no": F.row_number().over(order)})
    # From 0 (at the first value), along the curve, to the limit (interpolated).
    first = F.when((F.col("no") == 1), F.when(F.col("fpr") < limit, F.col("fpr") * F.col("pro")).otherwise(F.lit(limit) * F.col("pro")))
    cut = F.col("p0") + (F.col("pro") - F.col("p0")) * F.try_divide(F.lit(limit) - F.col("f0"), F.col("fpr") - F.col("f0"))
    area = F.when(F.col("no") == 1, first).when(F.col("fpr") <= limit, (F.col("fpr") - F.col("f0")) * (F.col("pro") + F.col("p0")) / 2).when(F.col("f0") < limit, (F.lit(limit) - F.col("f0")) * (F.col("p0") + cut) / 2).otherwise(F.lit(0.0))
    end = F.greatest(F.lit(0.0), F.lit(limit) - F.max("fpr")) * F.max_by("pro", F.struct("fpr", "pro"))
    return linked.groupBy(*by).agg(((F.sum(area) + end) / limit).alias("pro"))
