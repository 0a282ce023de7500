"""Tiling of strips and splits of tiles that don't leak groups between train and test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.operators.graph import shared_table
from loomlens.operators.ranking import hash_numbered, hash_offsets, hash_order


def tiles(strips: DataFrame, tile: int = 256) -> DataFrame:
    """(strip columns, tile_idx, x0, h): whole windows only, so a partial tail is dropped."""
    starts = F.when(F.col("width_px") >= tile, F.sequence(F.lit(0).cast("long"), F.col("width_px") - tile, F.lit(tile).cast("long")))
    rows = strips.select("*", F.explode(starts).alias("x0"))
    return rows.withColumns({"tile_idx": F.floor(F.col("x0") / tile), "h": F.least("height_px", F.lit(tile).cast("long"))})


def tile_name(roll: Column, strip: Column, tile_idx: Column) -> Column:
    return F.concat(roll.cast("string"), F.lit("_"), strip.cast("string"), F.lit("_t"), F.lpad(tile_idx.cast("string"), 2, "0"))


def group_of(name: Column) -> Column:
    """A tile's strip: its name without the tile suffix."""
    return F.regexp_replace(name, r"_t\d+$", "")


def split_by_group(rows: DataFrame, group: str, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """(group, n, split): groups in seeded hash order go whole to train while it has fewer than n_train
    rows, then to test while that has fewer than n_test; the rest gets no row.

    Only the group counts are ordered, in two levels (hash ranges, then inside them).
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_h", hash_order(seed, F.col(group))).withColumn("_range", F.substring("_h", 1, 2))
    counts = shared_table(counts)  # used three times; the rows are counted once
    totals = counts.groupBy("_range").agg(F.sum("n").alias("_n"))
    before = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_h", group).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(before, "_range").withColumn("cum", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    train = placed.where(F.col("cum") < n_train).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_train"))
    split = F.when(F.col("cum") < n_train, "train").when(F.col("cum") - F.col("_train") < n_test, "test")
    return placed.join(F.broadcast(train)).withColumn("split", split).where("split is not null").select(group, "n", "split")


def split_by_tile(rows: DataFrame, key: str, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """(key, split): the baseline that ignores groups; the first n_train rows in hash order, the next n_test.

    Rows are counted by range of the hash first; only those of ranges that reach into the chosen ones are shuffled and numbered, in two
    levels, so neither all nor the chosen ones have to fit one task. Keys are unique."""
    most, digits = n_train + n_test, 3
    offsets = hash_offsets(rows, [], key, seed, digits).where(F.col("_before") < most)
    numbered = hash_numbered(_in_ranges(rows.select(key), offsets, key, seed, digits), offsets, [], key, seed, digits).where(F.col("_no") <= most)
    return numbered.select(key, F.when(F.col("_no") <= n_train, "train").otherwise("test").alias("split"))


def _in_ranges(rows: DataFrame, offsets: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    """rows whose hash isn't beyond the last of the ranges, which are the first of the order."""
    last = offsets.agg(F.max("_range")).first()[0]
    return rows.where(F.substring(hash_order(seed, F.col(key)), 1, digits) <= F.lit(last)) if last is not None else rows.limit(0)


def leakage(rows: DataFrame, group: str) -> DataFrame:
    """One row: groups in train, in test, in both, and the share of test groups that train has too."""
    per = rows.groupBy(group).agg(F.max((F.col("split") == "train").cast("int")).alias("tr"), F.max((F.col("split") == "test").cast("int")).alias("te"))
    sums = per.agg(F.sum("tr").alias("train_groups"), F.sum("te").alias("test_groups"), F.sum(F.col("tr") * F.col("te")).alias("shared_groups"))
    return sums.withColumn("leak_share", F.try_divide("shared_groups", "test_groups"))


def regroup(tiles_of: DataFrame, n_train: int, n_test: int, seed: int = 0) -> DataFrame:
    """(name, split): normal tiles (label 0) of an existing split dealt anew by strip; defect tiles stay."""
    normal = tiles_of.where("label = 0").withColumn("_group", group_of(F.col("name")))
    dealt = split_by_group(normal, "_group", n_train, n_test, seed).select("_group", F.col("split").alias("_new"))
    return normal.join(dealt, "_group").select("name", F.col("_new").alias("split"), "label").unionByName(tiles_of.where("label <> 0").select("name", "split", "label"))


def defect_tiles(pixels: DataFrame, strips_with_mask: DataFrame, tile: int, min_pixels: int = 1, key: str = "image_id") -> DataFrame:
    """(strip, tile_y, tile_x, n_defect) of tiles with at least min_pixels mask pixels; strips without a
    mask are left out."""
    on = pixels.join(strips_with_mask, key, "left_semi").where("gt > 0")
    sums = on.groupBy(key, F.floor(F.col("y") / tile).alias("tile_y"), F.floor(F.col("x") / tile).alias("tile_x")).agg(F.count(F.lit(1)).alias("n_defect"))
    return sums.where(F.col("n_defect") >= min_pixels)


def catalog_columns(paths: DataFrame, path: str = "path") -> DataFrame:
    """(category, split, defect_type, stem, label) from <category>/<split>/<type>/<stem>.png."""
    part = lambda i: F.regexp_extract(path, r"([^/]+)/(train|test)/([^/]+)/([^/]+)\.png$", i)
    rows = paths.select(path, part(1).alias("category"), part(2).alias("split"), part(3).alias("defect_type"), part(4).alias("stem"))
    return rows.where("category <> ''").withColumn("label", (F.col("defect_type") != "good").cast("int"))


#: The categories that stand for 'textile'.
TEXTILE = ("carpet", "leather", "grid")


def select_categories(catalog: DataFrame, chosen: str | Sequence[str] | None = None) -> DataFrame:
    """(category) sorted: null or 'textile' is the fixed set, 'all' those with normal training images (none
    is an error), names pass through."""
    spark = catalog.sparkSession
    if chosen is None or chosen == "textile":
        return spark.createDataFrame([(c,) for c in TEXTILE], "category string")
    if chosen != "all":
        return spark.createDataFrame([(c,) for c in ([chosen] if isinstance(chosen, str) else chosen)], "category string")
    found = catalog.where("split = 'train' and defect_type = 'good'").select("category").distinct().orderBy("category")
    if not found.limit(1).count():
        raise ValueError("no category with normal training images")
    return found


def attach_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images with has_mask and mask_pixels by (category, defect_type, stem); no mask counts zero pixels."""
    return images.join(masks, ["category", "defect_type", "stem"], "left").withColumns({"has_mask": F.col("mask_pixels").isNotNull(), "mask_pixels": F.coalesce("mask_pixels", F.lit(0))})


def validate_uploads(uploads: DataFrame, known: DataFrame, models: DataFrame, limit: int, decodable: Column | None = None) -> DataFrame:
    """Add status and reason in the service's order of checks; 200 and null where accepted."""
    rows = uploads.join(known.select("category", F.lit(True).alias("_known")), "category", "left").join(models.select("category", F.lit(True).alias("_model")), "category", "left")
    size = F.octet_length("payload")
    reason = (
        F.when(F.col("_known").isNull(), F.struct(F.lit(404).alias("status"), F.lit("unknown category").alias("reason")))
        .when(F.col("_model").isNull(), F.struct(F.lit(503).alias("status"), F.lit("model not loadable").alias("reason")))
        .when(F.coalesce(size, F.lit(0)) == 0, F.struct(F.lit(400).alias("status"), F.lit("empty payload").alias("reason")))
        .when(size > limit, F.struct(F.lit(413).alias("status"), F.lit("too large").alias("reason")))
    )
    if decodable is not None:
        reason = reason.when(~decodable, F.struct(F.lit(400).alias("status"), F.lit("not decodable").alias("reason")))
    reason = reason.otherwise(F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("reason")))
    return rows.withColumn("_r", reason).select(*uploads.columns, "_r.status", "_r.reason")
