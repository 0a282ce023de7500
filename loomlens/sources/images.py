"""Image folders as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.operators.splits import catalog_columns


def image_catalog(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """(path, category, split, defect_type, stem, label) of <root>/<category>/<split>/<type>/*.png.

    Only names are read; a split that has no image is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root).select("path")
    found = catalog_columns(files)
    if split is not None:
        found = found.where(F.col("split") == split)
        if not found.limit(1).count():
            raise FileNotFoundError(f"no images for split {split!r} under {root}")
    return found


def _rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) in RGB order of rows in BGR(A) order or of grey ones; transparency is left out."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[:, :, 2::-1] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def resized(pixels: np.ndarray, size: int) -> np.ndarray:
    """size x size by half-pixel bilinear weights, widened where the picture shrinks so that every pixel counts;
    rounded half up."""

    def weights(n: int) -> np.ndarray:
        scale = n / size
        reach = max(1.0, scale)
        at = (np.arange(size) + 0.5) * scale - 0.5
        w = np.maximum(0.0, 1 - np.abs(np.arange(n)[None, :] - at[:, None]) / reach)
        return w / w.sum(axis=1, keepdims=True)

    found = np.einsum("oy,yxc,px->opc", weights(pixels.shape[0]), pixels.astype(np.float64), weights(pixels.shape[1]), optimize=True)
    return np.clip(np.floor(found + 0.5), 0, 255).astype(np.uint8)


def load_images(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(image_id: the path, height, width, channels, data) of the PNG files under path that can be decoded, in RGB
    order, grey ones too; with a size, resized to a square. See quarantined_images for the rest."""
    return read_images(spark, path, size).where("reason is null").drop("reason", "original_height", "original_width")


def quarantined_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, reason) of the PNG files under path that can't be decoded."""
    return read_images(spark, path).where("reason is not null").select("image_id", "reason")


def read_images(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """All PNG files under path: (image_id, height, width, channels, data, original_height, original_width, reason).
    A broken file has a reason and nulls; none is left out."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    rows = raw.select(F.col("image.origin").alias("image_id"), *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b.itertuples():
                if i.height <= 0 or i.width <= 0 or not i.data:
                    out.append((i.image_id, None, None, None, None, None, None, "not decodable"))
                    continue
                pixels = _rgb(i.data, i.height, i.width, i.nChannels)
                pixels = pixels if size is None else resized(pixels, size)
                out.append((i.image_id, *pixels.shape, pixels.tobytes(), i.height, i.width, None))
            yield pd.DataFrame(out, columns=["image_id", "height", "width", "channels", "data", "original_height", "original_width", "reason"]).astype({c: "Int32" for c in ("height", "width", "channels", "original_height", "original_width")})

    return rows.mapInPandas(decoded, "image_id string, height int, width int, channels int, data binary, original_height int, original_width int, reason string")


def pixel_rows(images: DataFrame) -> DataFrame:
    """(image_id, y, x, channel, value), one row per number of the array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.itertuples():
                y, x, c = np.indices((i.height, i.width, i.channels)).reshape(3, -1)
                yield pd.DataFrame({"image_id": i.image_id, "y": y, "x": x, "channel": c, "value": np.frombuffer(i.data, np.uint8).astype(np.float64)})

    return images.mapInPandas(run, "image_id string, y long, x long, channel long, value double")
