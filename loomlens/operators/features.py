"""Patch features: extraction surface, tokens, layers, pooling, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channel means and deviations of the usual pretraining set, in RGB order.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def patch_statistics(pixels: np.ndarray, grid: int) -> np.ndarray:
    """A deterministic extractor: mean, deviation, least and largest value of each channel of each patch.

    pixels: (h, w, channels) with sides divisible by grid; returns (grid * grid, 4 * channels).
    """
    h, w, c = pixels.shape
    cells = pixels.reshape(grid, h // grid, grid, w // grid, c).transpose(0, 2, 1, 3, 4).reshape(grid * grid, -1, c)
    return np.concatenate([cells.mean(1), cells.std(1), cells.min(1), cells.max(1)], axis=1)


def extract_features(images: DataFrame, grid: int, extractor: Callable[[np.ndarray, int], np.ndarray] = patch_statistics) -> DataFrame:
    """(image_id, row_id, col_id, feature) for images (image_id, height, width, channels, data).

    The extractor maps one (h, w, c) array to (grid * grid, dim); it is shipped with the function, so
    a model it loads lazily is loaded once per worker. Arrow batches bound what a task holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch.itertuples():
                pixels = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.channels).astype(np.float64)
                found = np.asarray(extractor(pixels, grid), np.float32)
                yield pd.DataFrame({"image_id": image.image_id, "row_id": np.repeat(np.arange(grid), grid), "col_id": np.tile(np.arange(grid), grid), "feature": list(found)})

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, f"image_id {kind}, row_id long, col_id long, feature array<float>")


def patch_tokens(tokens: DataFrame, gh: int, gw: int, prefix: int | None = None) -> DataFrame:
    """From (image_id, pos, token): prefix tokens dropped and the rest placed on the grid in row order. Without a number of prefix tokens
    they are all but the last gh * gw, and fewer tokens than cells is an error. With one, nothing is shuffled: an image that lacks tokens
    keeps those it has, at their cells, and a token beyond the grid is an error."""
    if prefix is None:
        last = tokens.groupBy("image_id").agg(F.max("pos").alias("_last"))
        ahead = F.col("_last") + 1 - gh * gw
        checked = F.when(ahead < 0, F.raise_error(F.lit("fewer tokens than grid cells")).cast("long")).otherwise(ahead)
        rows = tokens.join(last, "image_id").withColumn("i", F.col("pos") - checked)
    else:
        i = F.col("pos") - prefix
        rows = tokens.withColumn("i", F.when(i >= gh * gw, F.raise_error(F.lit("more tokens than grid cells")).cast("long")).otherwise(i))
    return rows.where("i >= 0").select("image_id", "i", F.floor(F.col("i") / gw).alias("row_id"), (F.col("i") % gw).alias("col_id"), "token")


def tokens_to_grid(sequences: DataFrame, gh: int, gw: int) -> DataFrame:
    """From (image_id, tokens array): one row per cell; a count other than gh * gw is an error."""
    n = F.size("tokens")
    checked = F.when(n != gh * gw, F.raise_error(F.lit("token count does not match the grid")).cast(sequences.schema["tokens"].dataType)).otherwise(F.col("tokens"))
    rows = sequences.select("image_id", F.posexplode(checked).alias("i", "token"))
    return rows.select("image_id", F.floor(F.col("i") / gw).alias("row_id"), (F.col("i") % gw).cast("long").alias("col_id"), "token")


def concat_layers(layers: Sequence[DataFrame], keys: Sequence[str] = ("image_id", "row_id", "col_id")) -> DataFrame:
    """Features of the same cells joined channel-wise in the given order."""
    out = layers[0].select(*keys, F.col("feature").alias("f0"))
    for i, layer in enumerate(layers[1:], 1):
        out = out.join(layer.select(*keys, F.col("feature").alias(f"f{i}")), list(keys))
    return out.select(*keys, F.concat(*[f"f{i}" for i in range(len(layers))]).alias("feature"))


def channels_of(patches: DataFrame, first: int | None = None, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, y, x, channel, value) of patches (row_id, col_id, feature), of the first channels if given."""
    feature = F.slice("feature", 1, first) if first else F.col("feature")
    return patches.select(*keys, F.col("row_id").alias("y"), F.col("col_id").alias("x"), F.posexplode(feature).alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


def concat_mixed_grids(fine: DataFrame, coarse: DataFrame, size_coarse: int, size_fine: int, n_fine: int) -> DataFrame:
    """Channels (image_id, y, x, channel, value) of a coarser layer, resampled to the first layer's grid
    and numbered after its n_fine channels."""
    from loomlens.operators.rasters import resampled

    up = resampled(coarse, size_coarse, size_fine, ("image_id", "channel"), "value").withColumn("channel", F.col("channel") + n_fine)
    return fine.select("image_id", "y", "x", "channel", "value").unionByName(up.select("image_id", "y", "x", "channel", "value"))


# ---- whole vectors: a row per cell, whatever the number of channels ----
def _vector(name: str = "feature") -> Column:
    return array_to_vector(F.col(name).cast("array<double>"))


def local_mean_features(patches: DataFrame, height: int, width: int, k: int = 3, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """k x k mean of features (keys, row_id, col_id, feature), one axis after the other, for each cell that is there; cells
    that aren't count as zero and the divisor is always k * k."""
    rows = patches.select(*keys, "row_id", "col_id", F.lit(True).alias("own"), _vector().alias("v"))
    for axis, other, side in (("row_id", "col_id", height), ("col_id", "row_id", width)):
        near = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col(axis) - k // 2), F.least(F.lit(side - 1).cast("long"), F.col(axis) + k // 2)))
        rows = rows.select(*keys, near.alias("_near"), axis, other, "own", "v").withColumn("own", F.col("own") & (F.col("_near") == F.col(axis)))
        rows = rows.groupBy(*keys, F.col("_near").alias(axis), other).agg(Summarizer.sum(F.col("v")).alias("v"), F.bool_or("own").alias("own"))
    return rows.where("own").select(*keys, "row_id", "col_id", F.transform(vector_to_array("v"), lambda v: v / (k * k)).alias("feature"))


def resampled_features(patches: DataFrame, size_in: int, size_out: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Bilinear resampling of features to size_out x size_out cells, one axis after the other; cells that aren't there count as zero."""
    from loomlens.operators.rasters import bilinear_weights, weight_table

    weights = weight_table(patches.sparkSession, bilinear_weights(size_in, size_out))
    rows = patches.select(*keys, "row_id", "col_id", _vector().alias("v"))
    for axis, other in (("row_id", "col_id"), ("col_id", "row_id")):
        spread = rows.join(weights, rows[axis] == weights["i"]).select(*keys, F.col("o").alias(axis), other, "v", "w")
        rows = spread.groupBy(*keys, axis, other).agg(Summarizer.sum(F.col("v"), F.col("w")).alias("v"))
    return rows.select(*keys, "row_id", "col_id", vector_to_array("v").alias("feature"))


def pooled_features(patches: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """(keys, feature): mean feature of the cells whose mask is on; of all cells where none is."""
    on = F.coalesce(F.col("mask"), F.lit(False))
    any_on = patches.groupBy(*keys).agg(F.max(on).alias("_any"))
    chosen = patches.withColumn("_on", on).join(any_on, list(keys)).where(F.col("_on") | ~F.col("_any"))
    return chosen.groupBy(*keys).agg(vector_to_array(Summarizer.mean(_vector())).alias("feature"))


def standardised_features(patches: DataFrame) -> DataFrame:
    """patches with each channel less its mean, in population deviations (0 counts as 1)."""
    found = patches.agg(Summarizer.metrics("mean", "variance", "count").summary(_vector()).alias("s")).select(vector_to_array("s.mean").alias("_m"), vector_to_array("s.variance").alias("_v"), F.col("s.count").alias("_n"))
    deviation = F.transform("_v", lambda v: F.when(v > 0, F.sqrt(v * (F.col("_n") - 1) / F.col("_n"))).otherwise(F.lit(1.0)))
    own = F.transform(F.col("feature").cast("array<double>"), lambda x, i: (x - F.col("_m")[i]) / F.col("_s")[i])
    return patches.join(F.broadcast(found.withColumn("_s", deviation))).withColumn("feature", own).drop("_m", "_v", "_n", "_s")  # one row


def normalise_channel(v: Column, channel: Column) -> Column:
    """(v / 255 - mean) / std of the channel (0, 1, 2 in RGB order)."""
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), channel.cast("int") + 1)
    return (v / 255 - pick(CHANNEL_MEAN)) / pick(CHANNEL_STD)


def denormalise_channel(v: Column, channel: Column) -> Column:
    """clip(v * std + mean, 0, 1) * 255, cut to an integer."""
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), channel.cast("int") + 1)
    return (F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * pick(CHANNEL_STD) + pick(CHANNEL_MEAN))) * 255).cast("int")


def pooled(cells: DataFrame, keys: Sequence[str] = ("image_id", "channel")) -> DataFrame:
    """Mean value over masked cells; over all cells where the mask is empty or null."""
    return cells.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("mask"), F.col("value"))), F.avg("value")).alias("value"))


def feature_checks(patches: DataFrame, dim: int, group: str = "category") -> DataFrame:
    """Per group: whether the grid is at least 2 x 2, every feature has `dim` numbers, and all are finite."""
    finite = F.forall("feature", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    sums = patches.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (F.max("row_id") + 1).alias("gh"), (F.max("col_id") + 1).alias("gw"),
        F.min(F.size("feature")).alias("dim_min"), F.max(F.size("feature")).alias("dim_max"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("n_bad"),
    )
    checks = F.array(
        F.struct(F.lit("grid").alias("check"), ((F.col("gh") > 1) & (F.col("gw") > 1)).alias("ok")),
        F.struct(F.lit("dimension").alias("check"), ((F.col("dim_min") == dim) & (F.col("dim_max") == dim)).alias("ok")),
        F.struct(F.lit("finite").alias("check"), (F.col("n_bad") == 0).alias("ok")),
        F.struct(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("ok")),
    )
    return sums.select(group, F.explode(checks).alias("c")).select(group, "c.check", "c.ok")


def map_checks(cells: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """(image_id, check, ok) of raw maps (image_id, y, x, score) and image scores (image_id, score): whether a map has
    each of its size x size cells once, all numbers are finite, and the score is the map's peak and not below 0."""
    inside = F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)
    sums = cells.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("y") * size + F.col("x")).alias("places"), F.count_if(~inside).alias("n_outside"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("n_bad"), F.max("score").alias("peak"),
    )
    rows = sums.join(scores.select("image_id", F.col("score").alias("own")), "image_id", "left")
    full = (F.col("n") == size * size) & (F.col("places") == size * size) & (F.col("n_outside") == 0)
    checks = F.array(
        F.struct(F.lit("size").alias("check"), full.alias("ok")),
        F.struct(F.lit("finite").alias("check"), (F.col("n_bad") == 0).alias("ok")),
        F.struct(F.lit("score").alias("check"), F.coalesce((F.col("own") == F.col("peak")) & (F.col("own") >= 0), F.lit(False)).alias("ok")),
    )
    return rows.select("image_id", F.explode(checks).alias("c")).select("image_id", "c.check", "c.ok")
