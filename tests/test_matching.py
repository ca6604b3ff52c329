"""Matching and links at their limits: spans of frames, and what a join's condition works out."""

import random

import pytest
from pyspark.sql import functions as F

from bayline.functions import boxes
from bayline.operators import matching


def boxes_of(spark, rows):
    schema = "frame long, box_id long, score double, x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(rows, schema).select("frame", "box_id", "score", boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("box"))


def made(rng, frames, at):
    out = []
    for f in frames:
        for i in range(rng.randint(0, 9)):
            x, y = rng.randint(0, 6), rng.randint(0, 6)
            out.append((f, at + i, rng.randint(0, 3) / 10, float(x), float(y), float(x + rng.randint(1, 6)), float(y + rng.randint(1, 6))))
    return out


def overlap(a, b):
    common = max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
    size = lambda c: (c[5] - c[3]) * (c[6] - c[4])
    return common / (size(a) + size(b) - common)


def plain(predicted, truth, at, order, tie):
    out = set()
    for f in {r[0] for r in predicted + truth}:
        ps, ts = sorted((r for r in predicted if r[0] == f), key=lambda r: (-r[2], r[1])), sorted((r for r in truth if r[0] == f), key=lambda r: r[1])
        side = 1 if tie == "first" else -1
        pairs = [(-overlap(p, t), i, side * j, j) for i, p in enumerate(ps) for j, t in enumerate(ts) if overlap(p, t) >= at]
        pairs.sort(key=(lambda x: x[:3]) if order == "by_overlap" else (lambda x: (x[1], x[0], x[2])))
        found = {}
        for _, i, _, j in pairs:
            if i not in found and j not in found.values():
                found[i] = j
        out |= {(f, p[1], ts[found[i]][1] if i in found else None) for i, p in enumerate(ps)}
        out |= {(f, None, t[1]) for j, t in enumerate(ts) if j not in found.values()}
    return out


@pytest.mark.parametrize("order, tie", [("by_prediction", "first"), ("by_prediction", "last"), ("by_overlap", "first")])
def test_matching_in_spans_of_frames(spark, order, tie):
    """Few pairs are measured at a time; the frames of a span are matched together."""
    rng = random.Random(5)
    predicted, truth = made(rng, range(40), 100), made(rng, range(3, 45), 500)
    found = matching.match(boxes_of(spark, predicted), boxes_of(spark, truth), "frame", 0.3, order=order, tie=tie).collect()
    assert {(r.frame, r.predicted_id, r.truth_id) for r in found} == plain(predicted, truth, 0.3, order, tie)
    keys, many = [0, 0, 1, 1, 2, 5, 5], [3, 4, matching.PAIRS - 1, 1, 5, 1, 1]
    import numpy as np

    assert matching._spans(np.array(keys), np.array(many)) == [(0, 2), (2, 4), (4, 7)]


def test_links_work_out_shares_outside_the_join(spark):
    """The join's condition holds no division: shares are worked out once, for pairs that overlap."""
    rng = random.Random(6)
    slots, vehicles = boxes_of(spark, made(rng, range(9), 1)).withColumnRenamed("box_id", "slot_id"), boxes_of(spark, made(rng, range(9), 50)).withColumnRenamed("box_id", "vehicle_id")
    for sides, link in ((slots, matching.link_boxes), (slots.withColumn("polygon", boxes.to_quad(F.col("box"))), matching.link_polygons)):
        found = link(sides, vehicles, "frame").where("occupies")
        joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert joins and all(" / " not in line and "lambda" not in line for line in joins)
        assert found.count() > 0


def test_polygons_are_worked_out_once(spark):
    """A polygon that is an expression itself stands in each function once, not once for each mention."""
    from bayline.functions import polygons

    shape = F.transform("pp", lambda v: F.struct(v.alias("x"), (v * v).alias("y")))
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0])], "id int, pp array<double>")
    for f in (polygons.shorter_side, polygons.bounds, polygons.area):
        plan = df.select(f(shape).alias("out"))._jdf.queryExecution().analyzed().toString()
        assert plan.splitlines()[0].count("pp#") == 1, f.__name__
    expected = min((2**0.5 + 26**0.5) / 2, (10**0.5 + 90**0.5) / 2)  # sides (0,0)-(1,1)-(2,4)-(3,9)-(0,0)
    assert abs(df.select(polygons.shorter_side(shape).alias("out")).first().out - expected) < 1e-12


def test_polygon_suppression_measures_kept_ones_only(spark, monkeypatch):
    """Odd polygons of several sizes against a plain walk; a turn measures a frame's kept polygon against those left."""
    import numpy as np
    import pyarrow as pa

    from bayline.functions import convex, polygons

    rng, rows = random.Random(7), []
    for f in range(30):
        for i in range(rng.randint(0, 8)):
            cx, cy, n = rng.random() * 3, rng.random() * 3, rng.choice((3, 4, 4, 6))
            turns = sorted(rng.random() * 6.28 for _ in range(n))
            corners = [(cx + np.cos(t), cy + np.sin(t)) for t in turns]
            rng.shuffle(corners)
            rows.append((f, i, rng.randint(0, 4) / 4, [{"x": float(x), "y": float(y)} for x, y in corners]))
    rows += [(90, 1, 0.5, None), (90, 2, 0.5, []), (90, 3, 0.4, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]), (None, 4, 0.9, None)]
    df = spark.createDataFrame(rows, "frame long, box_id long, score double, polygon array<struct<x:double,y:double>>")
    sides = df.select("frame", "box_id", polygons.canonical(F.col("polygon")).alias("p")).where("frame < 90")
    a, b = (sides.select("frame", F.col("box_id").alias(f"id_{n}"), F.col("p").alias(n)) for n in "ab")
    near = {(r.frame, r.id_a, r.id_b): r.iou for r in a.join(b, "frame").select("frame", "id_a", "id_b", polygons.iou(F.col("a"), F.col("b")).alias("iou")).collect()}
    for limit in (2, 100):
        expected = set()
        for f in {r[0] for r in rows if r[0] is not None}:
            kept = []
            for _, i, *_ in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
                if len(kept) < limit and all(near.get((f, i, k), 0.0) < 0.2 for k in kept):
                    kept.append(i)
            expected |= {(f, i) for i in kept}
        assert {(r.frame, r.box_id) for r in matching.suppress_polygons(df, "frame", 0.2, limit).collect()} == expected
    shapes = convex.polygons_of(pa.chunked_array([pa.array([r[3] for r in rows if r[0] is not None and r[0] < 90], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))
    key = [r[:2] for r in rows if r[0] is not None and r[0] < 90]
    pairs = [(i, j) for i in range(len(key)) for j in range(len(key)) if key[i][0] == key[j][0]]
    for most in (convex.CORNERS, 20):  # all at once, and a few corners at a time
        monkeypatch.setattr(convex, "CORNERS", most)
        measured = shapes.iou(*map(np.array, zip(*pairs, strict=True)))
        assert all(abs(max(m, 0.0) - near[(*key[i], key[j][1])]) < 1e-9 for m, (i, j) in zip(measured.tolist(), pairs, strict=True))
    plan = matching.suppress_polygons(df, "frame", 0.2, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the overlaps of all pairs were a join before


def test_calibration_follows_cameras_together(spark, monkeypatch):
    """Cameras of different length in lockstep against a walk of each alone, all at once and a few at a time."""
    import numpy as np

    rng, rows = random.Random(9), []
    for camera in [*range(20), 700]:
        for no in range(rng.randint(1, 6)):
            for i in range(rng.randint(1, 12)):
                x, y = rng.randint(0, 5) * 4.0 + rng.random(), rng.randint(0, 1) * 4.0
                rows.append((camera, no * 2, i, rng.random(), x, y, x + 4, y + 4))
    rows.sort()

    def plain(found):
        tracks, step, last = [], -1, None
        for _, no, _, score, *box in found:
            step, last = step + (no != last), no
            overlaps = [0 if t[1] == step else matching.iou_matrix(np.array([box]), np.array([[e / t[0][5] for e in t[0][:4]]]))[0, 0].round(9) for t in tracks]
            best = max(range(len(tracks)), key=lambda i: overlaps[i], default=None)
            if best is None or overlaps[best] < 0.45:
                tracks.append([[*box, score, 1], -1])
            else:
                tracks[best] = [[a + b for a, b in zip(tracks[best][0], [*box, score, 1], strict=True)], step]
        kept = sorted((t[0] for t in tracks if t[0][5] >= max(2, round(0.6 * (step + 1)))), key=lambda s: -s[5])
        return [(n + 1, s[5], step + 1, *(round(v / s[5], 9) for v in s[:5])) for n, s in enumerate(kept)] if len(kept) >= 4 else []

    expected = {(c, *s) for c in {r[0] for r in rows} for s in plain([r for r in rows if r[0] == c])}
    df = spark.createDataFrame(rows, "camera long, no long, box_id long, score double, x1 double, y1 double, x2 double, y2 double")
    df = df.select("camera", "no", "box_id", "score", boxes.box(*(F.col(c) for c in matching.EDGES)).alias("box"))
    found = matching.calibrate(df, "camera", "no")
    assert {(r.camera, r.slot_id, r.frames_seen, r.frames, *(round(r.box[e], 9) for e in matching.EDGES), round(r.confidence, 9)) for r in found.collect()} == expected and len(expected) > 8
    assert "[batch" in found._jdf.queryExecution().analyzed().toString()  # one camera to a call before
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(columns[0]) != 0]))
    tracks = lambda: {c: (s.tolist(), n) for c, s, n in matching._tracks(columns[1], columns[3], np.stack(columns[4:], axis=1), begins, 0.45)}
    together = tracks()
    monkeypatch.setattr(matching, "FOLLOWED", 30)
    assert tracks() == together and len(together) == 21
