"""Raster operators on long-form cells (image, y, x, value): all images and channels in one job.

Resampling and smoothing are linear and separable: maps are packed to one row each (operators/packed.py) and multiplied by one weight
matrix on both sides, so a job has one shuffle. Maps that come packed need none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.operators import packed as K


def bilinear_weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) weights of half-pixel bilinear resampling, clamped at the edges."""
    w = np.zeros((n_out, n_in))
    for o in range(n_out):
        at = max(0.0, (o + 0.5) * n_in / n_out - 0.5)
        low = min(int(at), n_in - 1)
        high = min(low + 1, n_in - 1)
        w[o, low] += 1 - (at - low)
        w[o, high] += at - low
    return w


def gaussian_weights(n: int, sigma: float) -> np.ndarray:
    """(n, n) weights of a normalised kernel of radius max(1, int(3 sigma)), zeros outside the raster."""
    radius = max(1, int(3 * sigma))
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    gap = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(np.abs(gap) <= radius, taps[np.clip(gap + radius, 0, 2 * radius)], 0.0)


def weight_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    o, i = np.nonzero(weights)
    return spark.createDataFrame([(int(a), int(b), float(weights[a, b])) for a, b in zip(o, i, strict=True)], "o long, i long, w double")


def map_weights(size_in: int, size_out: int, sigma: float | None = None) -> np.ndarray:
    """(size_out, size_in) weights of bilinear resampling, then Gaussian smoothing if sigma is given."""
    w = bilinear_weights(size_in, size_out)
    return w if sigma is None else gaussian_weights(size_out, sigma) @ w


def resampled(cells: DataFrame, size_in: int, size_out: int, keys: Sequence[str] = ("image_id",), value: str = "score", sigma: float | None = None) -> DataFrame:
    """Bilinear resampling to size_out x size_out, then Gaussian smoothing if sigma is given; absent cells count as zero."""
    return _multiplied(cells, map_weights(size_in, size_out, sigma), keys, value)


def smoothed(cells: DataFrame, size: int, sigma: float, keys: Sequence[str] = ("image_id",), value: str = "score") -> DataFrame:
    return _multiplied(cells, gaussian_weights(size, sigma), keys, value)


def _multiplied(cells: DataFrame, weights: np.ndarray, keys: Sequence[str], value: str) -> DataFrame:
    maps = K.pack(cells, weights.shape[1], weights.shape[1], keys, value).withColumn(value, K.weighted(value, weights))
    return K.unpack(maps, weights.shape[0], keys, value)


def image_scores(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.max("score").alias("score"))


def normalised(cells: DataFrame, bounds: DataFrame | None = None, on: Sequence[str] = (), keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """clip((v - vmin) / (vmax - vmin + 1e-8), 0, 1); where bounds are absent or null, the image's own."""
    own = cells.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    rows = cells.join(own, list(keys))
    if bounds is None:
        rows = rows.withColumns({"vmin": F.col("_lo"), "vmax": F.col("_hi")})
    else:
        rows = rows.join(bounds, list(on), "left") if on else rows.join(F.broadcast(bounds))  # one row per model
    low, high = F.coalesce("vmin", "_lo"), F.coalesce("vmax", "_hi")
    scaled = (F.col("score") - low) / (high - low + 1e-8)
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("_lo", "_hi", "vmin", "vmax")


def local_mean(cells: DataFrame, height: int, width: int, k: int = 3, keys: Sequence[str] = ("image_id", "channel"), value: str = "value") -> DataFrame:
    """k x k mean, stride 1; cells outside count as zero and the divisor is always k * k."""
    sums = cells.select(*keys, "y", "x", value)
    for axis, other, side in (("y", "x", height), ("x", "y", width)):
        near = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col(axis).cast("long") - k // 2), F.least(F.lit(side - 1).cast("long"), F.col(axis).cast("long") + k // 2)))
        sums = sums.select(*keys, near.alias(axis), other, value).groupBy(*keys, axis, other).agg(F.sum(value).alias(value))
    return sums.select(*keys, "y", "x", (F.col(value) / (k * k)).alias(value))


def mask_on_grid(pixels: DataFrame, height: int, width: int, gh: int, gw: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Area mean of a mask on gh x gw cells, on where above one half. Cell i reaches from floor(i height / gh) to
    ceil((i + 1) height / gh), so a pixel between two cells counts in both where sides aren't divisible."""
    cells = lambda c, g, n: F.explode(F.sequence(F.floor(F.col(c) * g / n), F.ceil((F.col(c) + 1) * g / n) - 1))
    rows = pixels.select(*keys, "x", "gt", cells("y", gh, height).alias("gy")).select(*keys, "gt", "gy", cells("x", gw, width).alias("gx"))
    return rows.groupBy(*keys, "gy", "gx").agg((F.avg("gt") > 0.5).alias("mask"))
