"""Maps as one array row each: the values of a raster in reading order.

A map of 224 x 224 cells is one row instead of 50,176, so resampling is a matrix product per map in an Arrow batch, the
statistics of a map are folds of its array, and nothing is grouped by image again. Cells that a map lacks are null: they
count as zero when maps are resampled and stand in no mask. Functions take and give columns, so a chain of them moves no row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<y: long, x: long, w: long, h: long, area: long, score: double>"


def stacked(maps: pa.Array, cells: int) -> np.ndarray:
    """(rows, cells) of a list array; absent cells and null rows are NaN, as are cells beyond a short row."""
    out = np.full((len(maps), cells), np.nan)
    counts = np.nan_to_num(maps.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    if len(counts) and counts.max() > cells:
        raise ValueError(f"a map has {counts.max()} cells, not {cells}")
    flat = maps.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(maps)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def _lists(values: np.ndarray) -> pa.Array:
    rows, cells = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * cells + 1, max(1, cells))[: rows + 1] if cells else np.zeros(rows + 1, np.int32), pa.int32()), pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel())))


def _placed(cells: int):
    @F.arrow_udf("array<double>")
    def place(entries: pa.Array) -> pa.Array:
        counts = entries.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = entries.flatten()
        at, values = flat.field("at").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(entries)), counts)
        inside = (at >= 0) & (at < cells)
        out = np.full((len(entries), cells), np.nan)
        out[row[inside], at[inside].astype(np.int64)] = values[inside]
        return _lists(out)

    return place


def pack(cells: DataFrame, height: int, width: int, keys: Sequence[str] = ("image_id",), value: str = "score") -> DataFrame:
    """(keys, value as an array) of rows (keys, y, x, value): one shuffle. Cells outside the raster are left out; of a
    cell that comes twice one value stays."""
    inside = (F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)
    at = F.when(inside, F.col("y") * width + F.col("x")).otherwise(F.lit(-1)).cast("int")
    entries = F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("value")))
    return cells.groupBy(*keys).agg(entries.alias("_entries")).select(*keys, _placed(height * width)("_entries").alias(value))


def unpack(maps: DataFrame, width: int, keys: Sequence[str] = ("image_id",), value: str = "score") -> DataFrame:
    """(keys, y, x, value): a row for each cell that a map has."""
    rows = maps.select(*keys, F.posexplode(value).alias("_at", value)).where(F.col(value).isNotNull())
    return rows.select(*keys, F.floor(F.col("_at") / width).alias("y"), (F.col("_at") % width).cast("long").alias("x"), value)


def weighted(maps: Column | str, weights: np.ndarray) -> Column:
    """Both axes of square maps by one weight matrix (out, in): W M W' for each map; every cell of the result has a value."""
    size_in = weights.shape[1]

    @F.arrow_udf("array<double>")
    def apply(rows: pa.Array) -> pa.Array:
        m = np.nan_to_num(stacked(rows, size_in * size_in)).reshape(len(rows), size_in, size_in)
        return _lists((weights @ m @ weights.T).reshape(len(rows), -1))

    return apply(maps)


def peak(maps: Column | str) -> Column:
    """The largest value of a map: its image score."""
    return F.array_max(maps)


def scaled(maps: Column | str, low: Column | None = None, high: Column | None = None) -> Column:
    """clip((v - low) / (high - low + 1e-8), 0, 1) of each value; a bound that is absent or null is the map's own."""
    maps = F.col(maps) if isinstance(maps, str) else maps
    own_low, own_high = F.array_min(maps), F.array_max(maps)
    low = own_low if low is None else F.coalesce(low, own_low)
    high = own_high if high is None else F.coalesce(high, own_high)
    return F.transform(maps, lambda v: F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low + 1e-8)))))


def share_from(maps: Column | str, threshold: float) -> Column:
    """Share of a map's cells at or above the threshold."""
    held = F.filter(maps, lambda v: v.isNotNull())
    return F.try_divide(F.size(F.filter(held, lambda v: v >= threshold)), F.size(held))


def _adaptive(m: np.ndarray, k: float) -> np.ndarray:
    """Cells at or above mean + k deviations (population) of their map; none of a flat map."""
    there = ~np.isnan(m)
    n = np.maximum(1, there.sum(axis=1, keepdims=True))
    mean = np.where(there, m, 0).sum(axis=1, keepdims=True) / n
    deviation = np.sqrt((np.where(there, m - mean, 0) ** 2).sum(axis=1, keepdims=True) / n)
    return there & (deviation >= 1e-6) & (np.where(there, m, -np.inf) >= mean + k * deviation)


def adaptive_mask(maps: Column | str, cells: int, k: float = 2.0) -> Column:
    """Numbers, in reading order, of the cells at or above mean + k deviations."""

    @F.arrow_udf("array<int>")
    def mask(rows: pa.Array) -> pa.Array:
        on = _adaptive(stacked(rows, cells), k)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(on.sum(axis=1))]), pa.int32()), pa.array(np.nonzero(on)[1], pa.int32()))

    return mask(maps)


def mask_boxes(on: np.ndarray, scores: np.ndarray, width: int, min_area: int, diagonal: bool = True) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(map of each box, its columns): bounding boxes of the components of masks (rows, cells), by map and reading order."""
    from loomlens.operators.localize import _label

    row, at = np.nonzero(on)
    height = on.shape[1] // width
    y, x = at // width, at % width
    first = _label(row * (height + 2) + y, x, diagonal)  # two empty lines between maps keep them apart
    names, comp = np.unique(first, return_inverse=True)
    n = len(names)
    ends = lambda v, f, start: f.at(out := np.full(n, start, v.dtype), comp, v) or out
    x0, x1, y0, y1 = (ends(v, f, s) for v, f, s in ((x, np.minimum, width), (x, np.maximum, -1), (y, np.minimum, height), (y, np.maximum, -1)))
    top = ends(scores[row, at], np.maximum, -np.inf)
    area, of = np.bincount(comp, minlength=n), row[names]
    columns = {"y": y0, "x": x0, "w": x1 - x0 + 1, "h": y1 - y0 + 1, "area": area, "score": top}
    order = np.lexsort((columns["h"], columns["w"], x0, y0, of))
    order = order[area[order] >= min_area]
    return of[order], {c: v[order] for c, v in columns.items()}


def boxes(maps: Column | str, height: int, width: int, k: float = 2.0, min_area: int = 64) -> Column:
    """Array of boxes (y, x, w, h, area, score: the peak) of the adaptive mask's 8-connected regions, in reading order."""

    @F.arrow_udf(f"array<{BOX}>")
    def find(rows: pa.Array) -> pa.Array:
        m = stacked(rows, height * width)
        of, columns = mask_boxes(_adaptive(m, k), m, width, min_area)
        kinds = {c: pa.float64() if c == "score" else pa.int64() for c in columns}
        structs = pa.StructArray.from_arrays([pa.array(v, kinds[c]) for c, v in columns.items()], list(columns))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(rows) + 1)), pa.int32()), structs)

    return find(maps)
