"""Boxes as columns: x, y, w, h in any one unit; E8, M1, M2, J1, P1, P2, P18."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def area(b) -> Column:
    return b[2] * b[3]


def intersection(a, b) -> Column:
    """0 where the boxes do not overlap strictly."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def iou(a, b) -> Column:
    """Intersection over union, 0 where boxes do not overlap or the union is not positive."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def clamp(v: Column, low, high) -> Column:
    """P18."""
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(v, F.lit(high) if not isinstance(high, Column) else high))


def half_even(v: Column) -> Column:
    """M1: a whole number, ties to even."""
    return F.bround(v).cast("long")


def half_up(v: Column) -> Column:
    """M1: a whole number, ties up."""
    return F.floor(v + 0.5)


def truncated(v: Column) -> Column:
    """M1: a whole number, towards 0."""
    return v.cast("long")


def round4(v: Column) -> Column:
    """Four decimals, half-even on the exact binary value (bround and round go by the decimal text)."""
    return F.regexp_replace(F.format_number(v, 4), ",", "").cast("double")


def normalised(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixel corners as [x, y, w, h] of the page, four decimals each."""
    return F.array(*(round4(v) for v in (x0 / width, y0 / height, (x1 - x0) / width, (y1 - y0) / height)))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, by: int = 3) -> Column:
    """Corners moved out by some pixels, inside the page."""
    return F.struct(F.greatest(F.lit(0), x0 - by).alias("x0"), F.greatest(F.lit(0), y0 - by).alias("y0"), F.least(width, x1 + by).alias("x1"), F.least(height, y1 + by).alias("y1"))
