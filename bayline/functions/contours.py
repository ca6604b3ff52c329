"""Outlines of many points brought to four corners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.functions import polygons

#: The tolerances that are tried, as shares of the outline's length.
FRACTIONS = (0.02, 0.03, 0.04, 0.05, 0.06, 0.08)
_TYPE = "array<struct<x:double,y:double>>"


def simplified(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Places of the points of a closed outline that are kept: no other lies further than epsilon from the outline they make.

    The outline is split at its first point and the one furthest from it; a span is split again at
    its furthest point as long as that lies beyond epsilon.
    """
    n = len(points)
    far = int(np.linalg.norm(points - points[0], axis=1).argmax())
    ring, kept, spans = np.vstack([points, points[:1]]), {0, far}, [(0, far), (far, n)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        inner, d = ring[a + 1 : b] - ring[a], ring[b] - ring[a]
        along = np.clip(inner @ d / max(float(d @ d), 1e-30), 0, 1)
        off = np.linalg.norm(inner - along[:, None] * d, axis=1)
        if off.max() > epsilon:
            k = a + 1 + int(off.argmax())
            kept.add(k)
            spans += [(a, k), (k, b)]
    return np.array(sorted(kept))


def _four(points: np.ndarray) -> np.ndarray | None:
    length = float(np.linalg.norm(np.roll(points, -1, 0) - points, axis=1).sum())
    for share in FRACTIONS:
        kept = simplified(points, share * length)
        if len(kept) == 4:
            return points[kept]
    return None


def _quads(column: pa.Array) -> pa.Array:
    out = []
    for outline in column.to_pylist():
        points = np.array([(p["x"], p["y"]) for p in outline or ()])
        found = _four(points) if len(points) >= 3 else None
        out.append(None if found is None else [{"x": x, "y": y} for x, y in found.tolist()])
    return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def contour_quads(rows: DataFrame, outline: str, out: str) -> DataFrame:
    """rows with out, four corners in canonical order for an outline: its simplification where that has four, else the least rectangle about it.

    Null for outlines of fewer than three points or without an area.
    """
    p = F.col(outline)
    found = rows.withColumn("__four", F.arrow_udf(_quads, _TYPE)(p)).withColumn("__quad", F.coalesce("__four", polygons.least_rectangle(p)))
    fine = (F.size(p) >= 3) & (polygons.area(p) > 0)
    return found.withColumn(out, F.when(fine, polygons.canonical(F.col("__quad")))).drop("__four", "__quad")
