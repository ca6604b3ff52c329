"""Polygons of an Arrow batch as arrays, with the order and the clip of functions.polygons."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Corners of clipped polygons that are held at a time.
CORNERS = 1 << 19


@dataclass(frozen=True)
class Polygons:
    """Corners by angle about their mean, one polygon after another; sizes is 0 for those without three finite corners."""

    corners: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray
    areas: np.ndarray

    def iou(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common over joint area of polygons a with polygons b; -1 where the boxes around them share no more than an edge."""
        x, y = self.bounds[a], self.bounds[b]
        met = np.flatnonzero((self.sizes[a] > 0) & (self.sizes[b] > 0) & (np.maximum(x[:, :2], y[:, :2]) < np.minimum(x[:, 2:], y[:, 2:])).all(axis=1))
        met = met[np.argsort(self.sizes[a[met]] + self.sizes[b[met]], kind="stable")]  # alike sizes together, so little is padded
        out, lo = np.full(len(a), -1.0), 0
        while lo < len(met):
            hi = lo + max(1, CORNERS // int(self.sizes[a[met[lo]]] + self.sizes[b[met[lo]]]))
            widest = int((self.sizes[a[met[lo:hi]]] + self.sizes[b[met[lo:hi]]]).max())
            here = met[lo : min(hi, lo + max(1, CORNERS // widest))]
            common = np.abs(_shoelace(_clip(self._padded(a[here]), self._padded(b[here]))))
            joint = self.areas[a[here]] + self.areas[b[here]] - common
            out[here] = np.divide(common, joint, out=np.zeros_like(common), where=joint != 0)
            lo += len(here)
        return out

    def _padded(self, i: np.ndarray) -> np.ndarray:
        """The corners of polygons i, the last one repeated up to the longest polygon."""
        sizes = self.sizes[i]
        return self.corners[self.begins[i][:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)]


def polygons_of(column: pa.ChunkedArray) -> Polygons:
    """The polygons of a column array<struct<x,y>>."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    corners = np.stack([c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()], axis=1)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = lambda c: np.bincount(owner, c, len(sizes))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.stack([count(corners[:, k]) / sizes for k in (0, 1)], axis=1)[owner]
        angle = np.arctan2(corners[:, 1] - mean[:, 1], corners[:, 0] - mean[:, 0])
    sound = (sizes >= 3) & (count(~np.isfinite(corners).all(axis=1)) == 0)
    corners = corners[np.lexsort((angle, owner))]
    bounds, areas = np.zeros((len(sizes), 4)), np.zeros(len(sizes))
    some = np.flatnonzero(sizes > 0)
    if len(some):
        low, high = (f.reduceat(corners, begins[some], axis=0) for f in (np.minimum, np.maximum))
        bounds[some] = np.concatenate([low, high], axis=1)
        after = np.arange(1, len(corners) + 1)
        after[begins[some] + sizes[some] - 1] = begins[some]
        turn = corners[:, 0] * corners[after, 1] - corners[after, 0] * corners[:, 1]
        areas[some] = np.abs(np.add.reduceat(turn, begins[some])) / 2
    return Polygons(corners, begins, np.where(sound, sizes, 0), bounds, areas)


def _shoelace(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=1)
    return (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(axis=1) / 2


def _clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of each subject inside its window, one half-plane cut for each edge; repeated corners change nothing."""
    for k in range(window.shape[1]):
        a, b = window[:, k], window[:, (k + 1) % window.shape[1]]
        edge = (b - a)[:, None]
        side = edge[..., 0] * (subject[..., 1] - a[:, None, 1]) - edge[..., 1] * (subject[..., 0] - a[:, None, 0])
        inside = side >= 0
        if inside.all():
            continue
        after, side_after = np.roll(subject, -1, axis=1), np.roll(side, -1, axis=1)
        leaves = inside != np.roll(inside, -1, axis=1)
        share = np.divide(side, side - side_after, out=np.zeros_like(side), where=leaves)
        met = subject + share[..., None] * (after - subject)
        # a corner inside stays, and where an edge leaves or comes back its crossing follows
        points = np.stack([subject, met], axis=2).reshape(len(subject), -1, 2)
        taken = np.stack([inside, leaves], axis=2).reshape(len(subject), -1)
        place = np.cumsum(taken, axis=1)
        many = place[:, -1]
        width = max(1, int(many.max()))
        row, at = np.nonzero(taken)
        cut = np.zeros((len(subject), width, 2))
        cut[row, place[row, at] - 1] = points[row, at]
        # rows with fewer corners repeat their last one; those without any are a point
        last = np.maximum(many - 1, 0)
        subject = cut[np.arange(len(cut))[:, None], np.minimum(np.arange(width), last[:, None])]
    return subject
