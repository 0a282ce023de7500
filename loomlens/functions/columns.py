"""Column functions of the grading standard and of the display rules.

Null inputs give null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard and of its units.
MM_PER_INCH = 25.4
MM_PER_YARD = 914.4
TOLERANCE = 40.0
LOW_CONFIDENCE = 0.6


def defect_points(size_mm: Column, is_hole: Column) -> Column:
    """Penalty points by the longest side; a null hole flag is no hole."""
    inches = size_mm / F.lit(MM_PER_INCH)
    by_length = F.when(inches <= 3, 1).when(inches <= 6, 2).when(inches <= 9, 3).when(inches > 9, 4)
    by_hole = F.when(inches <= 1, 2).when(inches > 1, 4)
    return F.when(F.coalesce(is_hole, F.lit(False)), by_hole).otherwise(by_length)


def size_mm(w_px: Column, h_px: Column, ppm: Column) -> Column:
    """The longer side in mm; pixels per mm of 0 or less is an error."""
    return F.when(ppm <= 0, F.raise_error(F.lit("pixels per mm must be above 0")).cast("double")).otherwise(F.greatest(w_px, h_px) / ppm)


def points_per_100sqyd(points: Column, length_yd: Column, width_in: Column) -> Column:
    return F.when((length_yd <= 0) | (width_in <= 0), F.lit(0.0)).otherwise(points * F.lit(3600.0) / F.nullif(length_yd * width_in, F.lit(0.0)))


def grade(p100: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(p100 <= tolerance, "first").when(p100 > tolerance, "second")


def severity(points: Column) -> Column:
    return F.when(points >= 3, "Major").otherwise("Minor")


def disposition(grade: Column) -> Column:
    return F.when(F.upper(grade) == "FIRST", "ACCEPTED").otherwise("REJECTED")


def shown_type(kind: Column) -> Column:
    return F.when(kind.isNull() | (kind == ""), "defect").when(kind == "unknown", "uncertain").otherwise(kind)


def uncertain(kind: Column, confidence: Column) -> Column:
    return F.coalesce(kind == "unknown", F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < LOW_CONFIDENCE)


def verdict(score: Column, threshold: Column) -> Column:
    """Strictly above the threshold; null without one."""
    return score > threshold


def effective_verdict(verdict: Column, num_defects: Column) -> Column:
    return F.coalesce(verdict, num_defects > 0)
