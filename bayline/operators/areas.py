"""The parking area of a frame, on square cells: slots and anchored vehicles, closed, in regions.

An approximation on cells of what a raster of pixels would give: a box takes every cell that it
touches, a disc of radius r is the cells within r cells, and a region's area is its number of
cells, holes not filled. There is no border: the plane goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.functions import boxes
from bayline.operators.matching import FRAMES
from bayline.operators.spool import written

#: The reach of support and of closing in shorter sides of a slot, and the least share of a region.
SUPPORT, CLOSING, SHARE = 6.0, 1.6, 0.05
#: Cells reach from -SIDE to SIDE in both directions.
SIDE = 1 << 11


def _cell_box(box: Column, cell: float) -> Column:
    edge = lambda e: F.floor(box[e] / cell).cast("int").alias(e)
    return F.struct(*(edge(e) for e in ("x1", "y1", "x2", "y2")))


def _half(r: Column, d: Column) -> Column:
    """How far the disc of radius r reaches to either side, d rows off its centre."""
    return F.floor(F.sqrt((r * r - d * d).cast("double"))).cast("int")


def _joined(runs: DataFrame, frame: str) -> DataFrame:
    """Runs (frame, r, y, a, b) of cells, those that meet or overlap in a row as one."""
    row = W.partitionBy(frame, "y").orderBy("a", "b")
    upto = F.max("b").over(row.rowsBetween(W.unboundedPreceding, -1))
    begins = runs.withColumn("begins", F.when(F.col("a") <= upto + 1, 0).otherwise(1))
    numbered = begins.withColumn("run", F.sum("begins").over(row.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(frame, "y", "run").agg(F.first("r").alias("r"), F.min("a").alias("a"), F.max("b").alias("b")).select(frame, "r", "y", "a", "b")


def closed(boxes_: DataFrame, frame: str) -> DataFrame:
    """(frame, y, a, b): runs of the cells of boxes (frame, c, r), dilated and then eroded by the disc of radius r.

    Only the ends of runs are kept: a box grown by a disc is one run a row, and a cell is left where
    the runs of all 2 * r + 1 rows around it, each shortened by the disc's reach in it, cover it.
    Runs of a frame stay in the frame's partition all along.
    """
    edge = lambda f, n: f(F.col(f"c.{n}1"), F.col(f"c.{n}2")).alias(f"{n}{1 if f is F.least else 2}")
    whole = boxes_.where(" and ".join(f"c.{e} is not null" for e in ("x1", "y1", "x2", "y2")))
    flat = whole.select(frame, "r", *(edge(f, n) for n in "xy" for f in (F.least, F.greatest)))
    rows = flat.select("*", F.explode(F.sequence(F.col("y1") - F.col("r"), F.col("y2") + F.col("r"))).alias("y"))
    half = _half(F.col("r"), F.greatest(F.col("y1") - F.col("y"), F.col("y") - F.col("y2"), F.lit(0)))
    grown = _joined(rows.select(frame, "r", "y", (F.col("x1") - half).alias("a"), (F.col("x2") + half).alias("b")), frame)
    off = grown.select("*", F.explode(F.sequence(-F.col("r"), F.col("r"))).alias("dy"))
    half = _half(F.col("r"), F.col("dy"))
    short = off.select(frame, "r", (F.col("y") - F.col("dy")).alias("y"), (F.col("a") + half).alias("a"), (F.col("b") - half).alias("b")).where("a <= b")
    ends = short.select(frame, "r", "y", F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("step")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("step")))))
    steps = ends.groupBy(frame, "y", "x").agg(F.first("r").alias("r"), F.sum("step").alias("step"))
    row = W.partitionBy(frame, "y").orderBy("x")
    cover = F.sum("step").over(row.rowsBetween(W.unboundedPreceding, W.currentRow))
    swept = steps.withColumns({"cover": cover, "next": F.lead("x").over(row)})
    return swept.where(F.col("cover") == 2 * F.col("r") + 1).select(frame, "y", F.col("x").alias("a"), (F.col("next") - 1).alias("b"))


def touching(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A label for each run of cells a to b of a row, in order of row and a; runs that touch, over corners too, have the least place of their region.

    Rows of different frames must lie two apart at least.
    """
    wide = 4 * SIDE
    above = (row + 1) * wide
    first = np.searchsorted(row * wide + b, above + a - 1)
    many = np.maximum(np.searchsorted(row * wide + a, above + b + 1, side="right") - first, 0)
    u = np.repeat(np.arange(len(row)), many)
    v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        # both runs, and those that their labels name, take the lesser label
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def labelled(runs: DataFrame, frame: str) -> DataFrame:
    """Runs (frame, y, a, b), those of a row apart, with region, the same for runs of a frame that touch by a side or a corner.

    The runs of some frames, pictures of a bounded size, are labelled together. The frame is a
    whole number below 2 ** 39.
    """
    rows = runs.select(*(F.col(c).cast("long").alias(c) for c in (frame, "y", "a", "b")))

    def label(group: pa.Table) -> pa.Table:
        group = group.sort_by([(frame, "ascending"), ("y", "ascending"), ("a", "ascending")])
        frames, y, a, b = (group[c].to_numpy() for c in (frame, "y", "a", "b"))
        row = (frames - frames.min()) * (4 * SIDE) + y + SIDE
        return pa.table([group[frame], group["y"], group["a"], group["b"], pa.array(touching(row, a + SIDE, b + SIDE))], names=[frame, "y", "a", "b", "region"])

    batch = F.floor(F.col(frame) / FRAMES).alias("batch")
    return rows.select(batch, "*").groupBy("batch").applyInArrow(label, f"{frame} long, y long, a long, b long, region long")


def parking_runs(slots: DataFrame, vehicles: DataFrame, frame: str, cell: float) -> DataFrame:
    """(frame, y, a, b, region): the cells, in runs from a to b of a row y, of the regions of each frame's parking area.

    slots have slot_id and box, vehicles vehicle_id and box. A vehicle's ground band counts as
    surface if a slot lies within SUPPORT shorter sides of it, by the median of the frame's slots.
    Slots and such bands are closed by CLOSING sides; both reaches are one cell at least. Regions
    below SHARE of their frame's cells go. A frame without slots has no area.
    """
    picture = W.partitionBy(frame)  # of a bounded size
    short = F.least(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    bays = slots.where(F.col(frame).isNotNull()).select(frame, _cell_box(F.col("box"), cell).alias("c"), short.alias("side"))
    side = F.percentile("side", F.lit(0.5)).over(picture)
    reach = lambda by: F.greatest(F.lit(1), F.round(F.col("side") * by / cell)).cast("int")
    bays = bays.withColumn("side", side).where("side is not null").select(frame, "c", reach(SUPPORT).alias("support"), reach(CLOSING).alias("r"))
    bands = vehicles.select(F.col(frame).alias("__frame"), _cell_box(boxes.footprint(F.col("box")), cell).alias("v"))
    gap = lambda a, b: F.greatest(F.col(f"c.{a}") - F.col(f"v.{b}"), F.col(f"v.{a}") - F.col(f"c.{b}"), F.lit(0))
    dx, dy = gap("x1", "x2"), gap("y1", "y2")
    near = (F.col("__frame") == F.col(frame)) & (dx * dx + dy * dy <= F.col("support") * F.col("support"))
    seeds = bands.join(bays, near, "left_semi").select(F.col("__frame").alias(frame), F.col("v").alias("c"), F.lit(None).cast("int").alias("r"))
    surface = bays.select(frame, "c", "r").union(seeds).withColumn("r", F.max("r").over(picture))
    regions = labelled(closed(surface, frame), frame).withColumn("n", F.col("b") - F.col("a") + 1)
    sized = regions.withColumns({"total": F.sum("n").over(picture), "n": F.sum("n").over(W.partitionBy(frame, "region"))})
    return sized.where(F.col("n") >= F.col("total") * SHARE).select(frame, "y", "a", "b", "region")


def parking_area(slots: DataFrame, vehicles: DataFrame, frame: str, cell: float) -> DataFrame:
    """(frame, x, y, region): the cells of parking_runs()."""
    runs = parking_runs(slots, vehicles, frame, cell)
    return runs.select(frame, F.explode(F.sequence("a", "b")).alias("x"), "y", "region")


def placed(vehicles: DataFrame, taken: DataFrame, area: DataFrame, frame: str, cell: float) -> DataFrame:
    """vehicles with their placement: on a slot that taken names, in the area by the ground point, outside it, or unknown without an area.

    area has cells (frame, x, y) or runs of cells (frame, y, a, b), no cell twice; it is written first.
    """
    ends = [F.col("x").alias("a"), F.col("x").alias("b")] if "x" in area.columns else ["a", "b"]
    area = written(area.select(frame, F.col("y").alias("__y"), *ends))
    ground = vehicles.withColumns({"x": F.floor((F.col("box.x1") + F.col("box.x2")) / 2 / cell).cast("int"), "y": F.floor((F.col("box.y2") - 0.5) / cell).cast("int")})
    mapped = ground.join(taken.select(frame, "vehicle_id", F.lit(True).alias("mapped")).distinct(), [frame, "vehicle_id"], "left")
    known = mapped.join(area.select(frame, F.lit(True).alias("known")).distinct(), frame, "left")
    here = F.col("y") == F.col("__y")
    reached = area.select(F.col(frame).alias("__frame"), "__y", "a", "b", F.lit(True).alias("inside"))
    found = known.join(reached, (F.col(frame) == F.col("__frame")) & here & F.col("x").between(F.col("a"), F.col("b")), "left")
    placement = F.when(F.col("mapped"), "in_mapped_space").when(F.col("known").isNull(), "area_unknown").when(F.col("inside"), "in_parking_area").otherwise("outside_parking_area")
    return found.select(*vehicles.columns, placement.alias("placement"))
