"""The extraction surface: a frozen model, declared by name, layers and dimension, run over batches of images.

The model is loaded by the first batch that a Python worker meets and kept for all later ones, whatever the task or the query. Images of one
shape that follow each other are stacked, at most `batch` of them, so that is what the model and a task hold besides one Arrow batch of bytes.
Every result is checked against the declaration; what doesn't fit ends the job with the extractor's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlens.operators.features import patch_statistics


@dataclass(frozen=True)
class Extractor:
    """load() gives a function from (images, height, width, channels) to (images, grid rows, grid columns, dim)."""

    name: str
    layers: tuple[str, ...]
    dim: int
    load: Callable[[], Callable[[np.ndarray], np.ndarray]]


def statistics_extractor(grid: int, channels: int) -> Extractor:
    """Mean, deviation, least and largest value of each channel of each patch: deterministic, without weights."""
    load = lambda: lambda images: np.stack([patch_statistics(x, grid).reshape(grid, grid, -1) for x in images])
    return Extractor(f"patch-statistics-{grid}-{channels}", ("pixels",), 4 * channels, load)


#: Models that this worker has loaded, by name and layers.
_LOADED: dict[tuple, Callable] = {}


def _model(extractor: Extractor) -> Callable[[np.ndarray], np.ndarray]:
    key = (extractor.name, extractor.layers)
    if key not in _LOADED:
        _LOADED[key] = extractor.load()
    return _LOADED[key]


def checked(extractor: Extractor, found, images: int) -> np.ndarray:
    """The model's result as (images, rows, columns, dim), or an error that names the extractor."""
    found = np.asarray(found, np.float32)
    if found.ndim != 4 or found.shape[0] != images or found.shape[3] != extractor.dim or found.shape[1] < 1 or found.shape[2] < 1:
        raise ValueError(f"{extractor.name} declares {images} grids of {extractor.dim} numbers, not an array of shape {found.shape}")
    return found


def _stacks(table: pa.RecordBatch, batch: int) -> Iterator[list[int]]:
    """Rows that follow each other and agree in shape, at most `batch` of them."""
    shapes = list(zip(*[table.column(c).to_pylist() for c in ("height", "width", "channels")], strict=True))
    held: list[int] = []
    for i, shape in enumerate(shapes):
        if held and (len(held) == batch or shape != shapes[held[0]]):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def extract(images: DataFrame, extractor: Extractor, batch: int = 8, profile=None) -> DataFrame:
    """(image_id, row_id, col_id, feature) of images (image_id, height, width, channels, data: bytes).

    profile: a resource profile for the stage, such as one that asks for a GPU a task. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            data = table.column("data")
            for rows in _stacks(table, batch):
                h, w, c = (table.column(n)[rows[0]].as_py() for n in ("height", "width", "channels"))
                pixels = np.stack([np.frombuffer(data[i].as_buffer(), np.uint8).reshape(h, w, c) for i in rows]).astype(np.float64)
                found = checked(extractor, _model(extractor)(pixels), len(rows))
                n, gh, gw, dim = found.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * gh * gw * dim + 1, dim), pa.int32()), pa.array(found.ravel(), pa.float32()))
                ids = table.column("image_id").take(pa.array(np.repeat(rows, gh * gw)))
                row, col = np.tile(np.repeat(np.arange(gh), gw), n), np.tile(np.arange(gw), n * gh)
                yield pa.RecordBatch.from_arrays([ids, pa.array(row, pa.int64()), pa.array(col, pa.int64()), lists], ["image_id", "row_id", "col_id", "feature"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, f"image_id {kind}, row_id long, col_id long, feature array<float>", profile=profile)
