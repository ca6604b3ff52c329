"""Small rasters inside array columns: peaks of heat maps and the corners that offsets give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bayline.functions.polygons import let

#: How far a corner may lie from its peak, and the room for rounding between equal neighbours.
REACH, SLACK = 0.15, 1e-7


def squashed(logits: Column) -> Column:
    """Probabilities of an array of logits held in [-30, 30]."""
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))))


def peaks(channels: Column, height: int, width: int, threshold: float) -> Column:
    """array<struct<y, x, confidence, corners>> of a map whose channels are arrays of height * width numbers, row by row.

    The first channel has logits: a cell is a peak if its probability reaches the threshold and no
    neighbour, of eight, is above it; equal neighbours are peaks alike. The other eight are x and y
    of four corners: the cell's centre and an offset of at most REACH, held in [0, 1].
    """

    def around(c: Column, i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        inside = F.filter(steps, lambda s: (y + s.dy).between(0, height - 1) & (x + s.dx).between(0, width - 1))
        return F.array_max(F.transform(inside, lambda s: F.element_at(c, ((y + s.dy) * width + x + s.dx + 1).cast("int"))))

    def corner(k: Column, i: Column) -> Column:
        centre = F.when(k % 2 == 0, (i % width + 0.5) / width).otherwise((F.floor(i / width) + 0.5) / height)
        offset = F.tanh(F.element_at(F.element_at(channels, (k + 2).cast("int")), (i + 1).cast("int"))) * REACH
        return F.greatest(F.least(centre + offset, F.lit(1.0)), F.lit(0.0))

    def found(c: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: (F.element_at(c, i + 1) >= threshold) & (F.element_at(c, i + 1) >= around(c, i) - SLACK))
        return F.transform(
            at,
            lambda i: F.struct(
                F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), F.element_at(c, i + 1).alias("confidence"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: corner(k, i)).alias("corners")
            ),
        )

    return let(squashed(F.element_at(channels, 1)), found)
