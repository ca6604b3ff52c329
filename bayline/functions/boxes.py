"""Axis-aligned boxes: struct<x1,y1,x2,y2:double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUND_BAND = 0.45


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box from its edges."""
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def area(b: Column) -> Column:
    """Area; zero for a box turned inside out."""
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Common area of two boxes."""
    width = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    height = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    return width * height


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge; cheap, to stand before exact tests."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def iou(a: Column, b: Column) -> Column:
    """Common area over joint area; zero where that is empty."""
    common = intersection(a, b)
    return F.coalesce(F.try_divide(common, area(a) + area(b) - common), F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """Shares of a and of b that the other covers; zeros where either is empty."""
    common = intersection(a, b)
    fine = (area(a) > 0) & (area(b) > 0)
    share = lambda x: F.when(fine, F.try_divide(common, area(x))).otherwise(0.0)
    return F.struct(share(a).alias("first"), share(b).alias("second"))


def footprint(b: Column, band: float = GROUND_BAND) -> Column:
    """The lower band of a box, where a vehicle meets the ground."""
    return box(b.x1, b.y2 - (b.y2 - b.y1) * band, b.x2, b.y2)


def contains(b: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a box or on its edge."""
    return (x >= b.x1) & (x <= b.x2) & (y >= b.y1) & (y <= b.y2)


def to_quad(b: Column) -> Column:
    """The corners of a box from the top left, clockwise on the screen."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(b.x1, b.y1), corner(b.x2, b.y1), corner(b.x2, b.y2), corner(b.x1, b.y2))


def unletterbox(b: Column, scale: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> Column:
    """A box of a letterboxed picture in shares of the original, held in [0, 1]."""
    back = lambda v, pad, size: F.least(F.greatest((v - pad) / scale / size, F.lit(0.0)), F.lit(1.0))
    return box(back(b.x1, pad_x, width), back(b.y1, pad_y, height), back(b.x2, pad_x, width), back(b.y2, pad_y, height))
