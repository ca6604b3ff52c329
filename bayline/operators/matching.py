"""Spatial links, greedy one-to-one matching, suppression and track confirmation.

Every join here has the frame (one image) as an equality, so it is a hash or merge join with the
geometry as a residual test. The greedy steps depend on order; they run as grouped Arrow
functions, one frame at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.functions import boxes, convex, polygons

LINK_AT, OCCUPY_AT = 0.10, 0.35


def link_boxes(slots: DataFrame, vehicles: DataFrame, frame: str) -> DataFrame:
    """Links of vehicles (vehicle_id, box) and slots (slot_id, box) of one frame, by ground footprint."""
    foot = vehicles.select(frame, "vehicle_id", boxes.footprint(F.col("box")).alias("foot"))
    both = slots.select(frame, "slot_id", F.col("box").alias("slot")).join(foot, frame)
    near = both.where(boxes.overlaps(F.col("slot"), F.col("foot")))
    return _links(near, frame, boxes.coverage(F.col("slot"), F.col("foot")), boxes.contains(F.col("slot"), (F.col("foot.x1") + F.col("foot.x2")) / 2, (F.col("foot.y1") + F.col("foot.y2")) / 2))


def link_polygons(slots: DataFrame, vehicles: DataFrame, frame: str) -> DataFrame:
    """The same with convex polygons as slots: the boxes around them come first, the clip for the rest."""
    around = polygons.bounds(F.col("slot"))
    foot = vehicles.select(frame, "vehicle_id", boxes.footprint(F.col("box")).alias("foot"))
    both = slots.select(frame, "slot_id", polygons.canonical(F.col("polygon")).alias("slot")).withColumn("around", around).join(foot, frame)
    near = both.where(boxes.overlaps(F.col("around"), F.col("foot")))
    return _links(near, frame, polygons.coverage(F.col("slot"), boxes.to_quad(F.col("foot"))), polygons.contains(F.col("slot"), (F.col("foot.x1") + F.col("foot.x2")) / 2, (F.col("foot.y1") + F.col("foot.y2")) / 2))


def _links(near: DataFrame, frame: str, cover: Column, inside: Column) -> DataFrame:
    """The links among pairs that are near. The generator keeps the shares out of the join's condition, which would work them out for every pair and once for each mention."""
    linked = near.select("*", F.explode(F.array(cover)).alias("cover"))
    best = F.greatest("cover.first", "cover.second")
    return linked.where(best >= LINK_AT).select(
        frame,
        "slot_id",
        "vehicle_id",
        F.col("cover.first").alias("slot_coverage"),
        F.col("cover.second").alias("vehicle_coverage"),
        inside.alias("centroid_inside"),
        (best >= OCCUPY_AT).alias("occupies"),
    )


def best_links(links: DataFrame, frame: str) -> DataFrame:
    """Each slot's link of the greatest slot coverage; the least vehicle_id among equals."""
    order = F.struct(F.col("slot_coverage"), -F.col("vehicle_id"))
    return links.groupBy(frame, "slot_id").agg(F.max_by(F.struct("vehicle_id", "slot_coverage", "occupies"), order).alias("b")).select(frame, "slot_id", "b.*")


def unmapped(vehicles: DataFrame, links: DataFrame, frame: str) -> DataFrame:
    """Vehicles that occupy no slot."""
    return vehicles.join(links.where("occupies").select(frame, "vehicle_id"), [frame, "vehicle_id"], "left_anti")


def explained_share(detected: DataFrame, known: DataFrame, frame: str, at: float, least: int = 1) -> DataFrame:
    """Per frame the share of detected boxes (box_id, box) that a known box explains; 0 with fewer than least."""
    pairs = detected.select(frame, "box_id", F.col("box").alias("a")).join(known.select(frame, F.col("box").alias("b")), frame)
    hit = pairs.where(boxes.iou(F.col("a"), F.col("b")) >= at).select(frame, "box_id").distinct()
    marked = detected.select(frame, "box_id").join(hit.withColumn("hit", F.lit(1)), [frame, "box_id"], "left")
    share = F.avg(F.coalesce("hit", F.lit(0)).cast("double"))
    return marked.groupBy(frame).agg(F.count("*").alias("detected"), F.when(F.count("*") >= least, share).otherwise(0.0).alias("agreement"))


def confirm_tracks(detections: DataFrame, camera: str, frame_no: str, at: float = 0.45, history: int = 3, required: int = 2) -> DataFrame:
    """Whether each detection (box_id, box) recurs: seen in required frames of this and the history before.

    A camera's first required - 1 frames accept everything. Frames are numbered without gaps.
    """
    now, then = detections.alias("now"), detections.alias("then")
    back = [F.col(f"then.{frame_no}") == F.col(f"now.{frame_no}") - i for i in range(1, history + 1)]
    seen: DataFrame | None = None
    for step in back:  # one equality join for each frame back, so no range join is needed
        part = now.join(then, (F.col(f"now.{camera}") == F.col(f"then.{camera}")) & step).where(boxes.iou(F.col("now.box"), F.col("then.box")) >= at)
        part = part.select(f"now.{camera}", f"now.{frame_no}", "now.box_id", F.col(f"then.{frame_no}").alias("seen_in"))
        seen = part if seen is None else seen.unionByName(part)
    counted = seen.groupBy(camera, frame_no, "box_id").agg(F.count_distinct("seen_in").alias("before"))
    first = detections.groupBy(camera).agg(F.min(frame_no).alias("first"))
    marked = detections.join(counted, [camera, frame_no, "box_id"], "left").join(first, camera)
    sightings = F.coalesce("before", F.lit(0)) + 1
    return marked.select(camera, frame_no, "box_id", ((F.col(frame_no) - F.col("first") < required - 1) | (sightings >= required)).alias("confirmed"))


# ---- grouped steps -------------------------------------------------------------------------

EDGES = ("x1", "y1", "x2", "y2")
#: Frames, numbered one after another, that are handed to Python together.
FRAMES = 256


def _batch(frame: str) -> Column:
    """The batch of FRAMES frames or fewer that a row belongs to."""
    return F.floor(F.col(frame).cast("long") / FRAMES).alias("batch")


def _flat(rows: DataFrame, frame: str) -> DataFrame:
    """Long ids, the edges as columns of their own, and the batch that a row belongs to."""
    edges = [F.col("box")[e].alias(e) for e in EDGES]
    return rows.select(_batch(frame), F.col(frame).cast("long").alias(frame), F.col("box_id").cast("long"), F.col("score").cast("double"), *edges)


def _frames(table: pa.Table, frame: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores, boxes) of each frame of a batch, ids ascending."""
    if not table.num_rows:
        return {}
    table = table.sort_by([(frame, "ascending"), ("box_id", "ascending")])
    keys, edges = table[frame].to_numpy(), np.stack([table[e].to_numpy() for e in EDGES], axis=1)
    ids, scores = table["box_id"].to_numpy(), table["score"].to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    spans = zip(begins.tolist(), np.append(begins[1:], len(keys)).tolist(), strict=True)
    return {int(keys[a]): (ids[a:b], scores[a:b], edges[a:b]) for a, b in spans}


def _boxes(table: pa.Table, column: str = "box") -> np.ndarray:
    boxes_ = table[column].combine_chunks()
    return np.stack([boxes_.field(n).to_numpy(zero_copy_only=False) for n in EDGES], axis=1) if len(boxes_) else np.empty((0, 4))


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    common = np.prod(np.maximum(high - low, 0), axis=2)
    size = lambda x: np.prod(np.maximum(x[:, 2:] - x[:, :2], 0), axis=1)
    union = size(a)[:, None] + size(b)[None] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def suppress(boxes_: DataFrame, frame: str, threshold: float) -> DataFrame:
    """Greedy suppression: by falling score, ties by box_id, a box goes if a kept one overlaps it by threshold."""

    def keep(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for key, (ids, scores, edges) in _frames(group, frame).items():
            overlap = iou_matrix(edges, edges) >= threshold
            alive = np.ones(len(ids), bool)
            for i in np.argsort(-scores, kind="stable").tolist():
                if alive[i]:
                    out.append((key, int(ids[i]), float(scores[i])))
                    alive &= ~overlap[i]
        return _columns(out, [(frame, pa.int64()), ("box_id", pa.int64()), ("score", pa.float64())])

    return _flat(boxes_, frame).groupBy("batch").applyInArrow(keep, f"{frame} long, box_id long, score double")


def suppress_polygons(polygons_: DataFrame, frame: str, threshold: float, limit: int) -> DataFrame:
    """Greedy suppression of convex polygons (box_id, score, polygon), of which a frame keeps limit at most.

    By falling score, ties by box_id, a polygon goes if a kept one overlaps it by threshold. The
    frames of a batch go in turns together: a turn keeps the first polygon left of each frame and
    drops what it overlaps, so that kept ones are measured and never all pairs. Polygons without
    three finite corners overlap nothing; rows without a frame take no part.
    """

    def keep(group: pa.Table) -> pa.Table:
        keys, ids, scores = (group[c].to_numpy() for c in (frame, "box_id", "score"))
        shapes = convex.polygons_of(group["polygon"])
        left, kept = np.lexsort((ids, -scores, keys)), []
        for turn in range(limit):
            if not len(left):
                break
            first = np.concatenate([[True], np.diff(keys[left]) != 0])
            kept.append(left[first])
            if turn + 1 < limit:
                of, left = left[first][np.cumsum(first) - 1][~first], left[~first]
                left = left[shapes.iou(left, of) < threshold]
        return group.take(np.concatenate(kept) if kept else np.empty(0, np.int64)).select([frame, "box_id", "score"])

    rows = polygons_.where(F.col(frame).isNotNull()).select(_batch(frame), F.col(frame).cast("long").alias(frame), F.col("box_id").cast("long"), F.col("score").cast("double"), "polygon")
    return rows.groupBy("batch").applyInArrow(keep, f"{frame} long, box_id long, score double")


#: Pairs of boxes that a matching measures together; a frame with more is measured alone.
PAIRS = 1 << 19


def _sorted(table: pa.Table, frame: str, by_score: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(frames, ids, scores, boxes) of a batch by frame and id, or by frame, falling score and id."""
    keys, ids, scores = (table[c].to_numpy() for c in (frame, "box_id", "score"))
    edges = np.stack([table[e].to_numpy() for e in EDGES], axis=1)
    order = np.lexsort((ids, -scores, keys) if by_score else (ids, keys))
    return keys[order], ids[order], scores[order], edges[order]


def _spans(keys: np.ndarray, many: np.ndarray) -> list[tuple[int, int]]:
    """Spans of rows, each of whole frames, with PAIRS pairs or fewer or a single frame; many is a row's number of pairs."""
    ends = np.append(np.flatnonzero(np.diff(keys) != 0) + 1, len(keys)) if len(keys) else np.empty(0, np.int64)
    upto = np.cumsum(many)
    out, lo = [], 0
    while lo < len(keys):
        full = upto[ends - 1] - (upto[lo - 1] if lo else 0) > PAIRS
        here = ends[(ends > lo) & ~full]
        hi = int(here[-1]) if len(here) else int(ends[ends > lo][0])
        out.append((lo, hi))
        lo = hi
    return out


def _near(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, lo: int, hi: int, at: float, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, IoU) of rows i from lo to hi of a and rows j from first to last of b that overlap by at."""
    many = (last - first)[lo:hi]
    i = np.repeat(np.arange(lo, hi), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[lo:hi], many)
    x, y = a[i], b[j]
    sides = np.maximum(np.minimum(x[:, 2:], y[:, 2:]) - np.maximum(x[:, :2], y[:, :2]), 0)
    common = sides[:, 0] * sides[:, 1]
    size = lambda z: np.prod(np.maximum(z[:, 2:] - z[:, :2], 0), axis=1)
    union = size(x) + size(y) - common
    overlap = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
    met = (overlap >= at) & ((overlap > 0) | (not positive))
    return i[met], j[met], overlap[met]


def _columns(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def match(predicted: DataFrame, truth: DataFrame, frame: str, at: float, order: str = "by_prediction", tie: str = "first") -> DataFrame:
    """Greedy one-to-one matching of predicted and true boxes (box_id, score, box) of each frame.

    order "by_prediction": predictions by falling score take the best truth left; "by_overlap": all
    pairs by falling overlap. tie says which of equal truths is taken, "first" or "last". Returns
    (frame, predicted_id, truth_id, overlap, predicted_score, truth_score, corner_error), one id null
    for those without a partner; corner_error is the mean distance of the corners of a pair.
    """
    kinds = [(frame, pa.int64()), ("predicted_id", pa.int64()), ("truth_id", pa.int64()), *((c, pa.float64()) for c in ("overlap", "predicted_score", "truth_score", "corner_error"))]

    def pair(p: pa.Table, t: pa.Table) -> pa.Table:
        keys, pid, scores, a = _sorted(p, frame, by_score=True)
        true_keys, tid, true_scores, b = _sorted(t, frame)
        first, last = np.searchsorted(true_keys, keys), np.searchsorted(true_keys, keys, side="right")
        near = [_near(a, b, first, last, lo, hi, at, positive=order != "by_overlap") for lo, hi in _spans(keys, last - first)]
        i, j, overlap = (np.concatenate(c) for c in zip(*near, strict=True)) if near else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        rank = np.lexsort((j, i, -overlap)) if order == "by_overlap" else np.lexsort((j if tie == "first" else -j, -overlap, i))
        partner, chosen, free = np.full(len(pid), -1), np.zeros(len(pid)), np.ones(len(tid), bool)
        for k, u, v in zip(rank.tolist(), i[rank].tolist(), j[rank].tolist(), strict=True):
            if partner[u] < 0 and free[v]:
                partner[u], chosen[u], free[v] = v, overlap[k], False
        alone, left = partner < 0, np.flatnonzero(free)
        of, none = np.where(alone, 0, partner), np.ones(len(left), bool)
        at_truth = lambda x: x[of] if len(x) else np.zeros((len(of), *x.shape[1:]), x.dtype)
        off = np.abs(a - at_truth(b))
        corners = np.hypot(off[:, [0, 2, 2, 0]], off[:, [1, 1, 3, 3]]).mean(axis=1)
        blank = np.zeros(len(left))
        columns = [
            (keys, None, true_keys[left], None), (pid, None, tid[left], none), (at_truth(tid), alone, tid[left], None), (chosen, alone, blank, none),
            (scores, None, blank, none), (at_truth(true_scores), alone, true_scores[left], None), (corners, alone, blank, none),
        ]
        return pa.table([pa.chunked_array([pa.array(x, kind, mask=m), pa.array(y, kind, mask=n)]) for (x, m, y, n), (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    left, right = _flat(predicted, frame).groupBy("batch"), _flat(truth, frame).groupBy("batch")
    return left.cogroup(right).applyInArrow(pair, f"{frame} long, predicted_id long, truth_id long, overlap double, predicted_score double, truth_score double, corner_error double")


def calibrate(detections: DataFrame, camera: str, frame_no: str, at: float = 0.45, share: float = 0.6, least_slots: int = 4) -> DataFrame:
    """Slots that recur across a camera's frames, as mean boxes with the frames that saw them.

    Detections (box_id, box, score) go in order of frame and id, and of box and score for equal ids. Each joins the track whose mean
    box overlaps it most, the earlier of equals, by at least at; a track takes one detection of a
    frame, besides the one that opened it. What finds no track opens one. A track survives with
    max(2, share of the frames) detections. A camera with fewer than least_slots survivors has no
    layout and returns no row; slots are numbered by falling support. The cameras of a batch are
    followed together, a detection of each at a time.
    """

    def consensus(group: pa.Table) -> pa.Table:
        keys, frames, scores, edges = group[camera].to_numpy(), group[frame_no].to_numpy(), group["score"].to_numpy(), _boxes(group)
        order = np.lexsort((scores, *edges.T[::-1], group["box_id"].to_numpy(), frames, keys))
        keys, frames, scores, edges = keys[order], frames[order], scores[order], edges[order]
        begins = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])) if len(keys) else np.empty(0, np.int64)
        out = [(np.empty(0, np.int64), np.empty((0, 6)), 0)]
        for c, sums, total in _tracks(frames, scores, edges, begins, at):
            kept = np.flatnonzero(sums[:, 5] >= max(2, round(share * total)))
            if len(kept) >= least_slots:
                kept = kept[np.argsort(-sums[kept, 5], kind="stable")]
                out.append((np.full(len(kept), keys[begins[c]]), sums[kept], total))
        names, kept = np.concatenate([c for c, _, _ in out]), np.concatenate([s for _, s, _ in out])
        numbers, totals = np.concatenate([np.arange(1, len(c) + 1) for c, _, _ in out]), np.concatenate([np.full(len(c), t) for c, _, t in out])
        seen = kept[:, 5]
        box = pa.StructArray.from_arrays([pa.array(kept[:, i] / seen) for i in range(4)], list(EDGES))
        columns = [names, numbers, seen.astype(np.int64), totals, kept[:, 4] / seen]
        return pa.table([*map(pa.array, columns), box], names=[camera, "slot_id", "frames_seen", "frames", "confidence", "box"])

    rows = detections.select(F.floor(F.col(camera).cast("long") / CAMERAS).alias("batch"), F.col(camera).cast("long"), F.col(frame_no).cast("long"), F.col("box_id").cast("long"), F.col("score").cast("double"), "box")
    return rows.groupBy("batch").applyInArrow(consensus, f"{camera} long, slot_id long, frames_seen long, frames long, confidence double, box struct<x1:double,y1:double,x2:double,y2:double>")


#: Cameras, numbered one after another, that are handed to Python together, and detections of those that are followed together.
CAMERAS, FOLLOWED = 64, 1 << 17


def _tracks(frames: np.ndarray, scores: np.ndarray, edges: np.ndarray, begins: np.ndarray, at: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """(camera, sums of its tracks, number of its frames); a camera's detections stand in order from its place in begins on.

    Cameras go in lockstep, each by one detection a step, the longest first, so that those at work
    stand in front. A track's sums are of edges, score and detections.
    """
    many = np.diff(begins, append=len(frames))
    turns = np.concatenate([[False], np.diff(frames) != 0])[: len(frames)]
    turns[begins] = False
    step = np.cumsum(turns)
    by = np.argsort(-many, kind="stable")
    while len(by):
        here, by = np.split(by, [max(1, FOLLOWED // int(many[by[0]]))])
        first, count = begins[here], many[here]
        sums, joined, n = np.zeros((len(here), 16, 6)), np.full((len(here), 16), -1), np.zeros(len(here), np.int64)
        for t in range(int(count[0])):
            busy = int(np.searchsorted(-count, -t))  # cameras with more than t detections
            g, rows, widest = np.arange(busy), first[:busy] + t, int(n[:busy].max())
            box, now = edges[rows], step[rows]
            k, hit = n[:busy].copy(), np.zeros(busy, bool)
            if widest:
                held = sums[:busy, :widest]
                mean = held[..., :4] / np.maximum(held[..., 5:], 1)
                sides = np.maximum(np.minimum(box[:, None, 2:], mean[..., 2:]) - np.maximum(box[:, None, :2], mean[..., :2]), 0)
                common = sides[..., 0] * sides[..., 1]
                size = lambda x: np.maximum(x[..., 2] - x[..., 0], 0) * np.maximum(x[..., 3] - x[..., 1], 0)
                union = size(box)[:, None] + size(mean) - common
                overlap = np.divide(common, union, out=np.zeros_like(common), where=union > 0).round(9)  # equal overlaps stay equal
                overlap[(joined[:busy, :widest] == now[:, None]) | (np.arange(widest) >= n[:busy, None])] = -1
                best = overlap.argmax(axis=1)
                hit = overlap[g, best] >= max(at, 1e-12)
                k[hit] = best[hit]
                joined[g[hit], best[hit]] = now[hit]
            n[:busy] += ~hit
            if int(n.max()) > sums.shape[1]:
                sums, joined = np.concatenate([sums, np.zeros_like(sums)], axis=1), np.concatenate([joined, np.full_like(joined, -1)], axis=1)
            sums[g, k] += np.column_stack([box, scores[rows], np.ones(busy)])
        for i, c in enumerate(here.tolist()):
            yield c, sums[i, : n[i]], int(step[first[i] + count[i] - 1] - step[first[i]]) + 1
