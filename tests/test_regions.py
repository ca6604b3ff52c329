"""Areas, components, rectangles, peaks, registration and the confirming stream against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayline.functions import boxes, contours, polygons, rasters
from bayline.operators import areas, matching, registration
from bayline.streaming.confirmation import confirm_stream


def plain_area(slots, vehicles, cell):
    side = np.median([min(x2 - x1, y2 - y1) for x1, y1, x2, y2 in slots])
    reach = lambda by: max(1, math.floor(side * by / cell + 0.5))
    cells = lambda b: {(x, y) for x in range(math.floor(b[0] / cell), math.floor(b[2] / cell) + 1) for y in range(math.floor(b[1] / cell), math.floor(b[3] / cell) + 1)}
    disc = lambda r: [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if x * x + y * y <= r * r]
    bays = set().union(*map(cells, slots))
    near = {(x + a, y + b) for x, y in bays for a, b in disc(reach(6.0))}
    mask = set(bays)
    for b in vehicles:
        band = cells((b[0], b[3] - (b[3] - b[1]) * 0.45, b[2], b[3]))
        mask |= band if band & near else set()
    d = disc(reach(1.6))
    grown = {(x + a, y + b) for x, y in mask for a, b in d}
    left = {(x, y) for x, y in grown if all((x + a, y + b) in grown for a, b in d)}
    regions, total = [], len(left)
    while left:
        todo, region = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            region.add((x, y))
            for p in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    todo.append(p)
        regions.append(frozenset(region))
    return {r for r in regions if len(r) >= 0.05 * total}


def test_parking_area(spark):
    rng = random.Random(6)
    box = lambda lo, hi: [float(v) for v in (lambda x, y: (x, y, x + rng.randint(4, 9), y + rng.randint(4, 9)))(rng.randint(lo, hi), rng.randint(lo, hi))]
    slots = {f: [box(-20, 90) for _ in range(rng.randint(1, 14))] for f in range(6)}
    vehicles = {f: [box(-60, 200) for _ in range(12)] for f in range(8)}
    rows = lambda kind, of: spark.createDataFrame([(f, i, *b) for f, bs in of.items() for i, b in enumerate(bs)], f"frame long, {kind} long, x1 double, y1 double, x2 double, y2 double").select("frame", kind, boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("box"))
    a, b = rows("slot_id", slots), rows("vehicle_id", vehicles)
    area = areas.parking_area(a, b, "frame", 3.0)
    found = {}
    for r in area.collect():
        found.setdefault(r.frame, {}).setdefault(r.region, set()).add((r.x, r.y))
    assert {f: {frozenset(c) for c in x.values()} for f, x in found.items()} == {f: plain_area(slots[f], vehicles[f], 3.0) for f in slots}
    placed = areas.placed(b, a.select("frame", F.col("slot_id").alias("vehicle_id")).where("vehicle_id = 0"), area, "frame", 3.0)
    for r in placed.collect():
        x, y = math.floor((r.box.x1 + r.box.x2) / 2 / 3), math.floor((r.box.y2 - 0.5) / 3)
        inside = any((x, y) in c for c in found.get(r.frame, {}).values())
        expected = "in_mapped_space" if r.vehicle_id == 0 and r.frame in slots else "area_unknown" if r.frame not in slots else "in_parking_area" if inside else "outside_parking_area"
        assert r.placement == expected


def plain_rectangle(points):
    best = math.inf
    for i in range(3600):
        angle = math.pi * i / 3600
        u, v = points @ [math.cos(angle), math.sin(angle)], points @ [-math.sin(angle), math.cos(angle)]
        best = min(best, float(np.ptp(u) * np.ptp(v)))
    return best


def test_least_rectangles(spark):
    rng = np.random.default_rng(3)
    shapes = [rng.random((n, 2)) for n in (3, 4, 5, 8, 12) for _ in range(4)]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(shapes)], "id int, pairs array<array<double>>").withColumn("p", polygons.from_pairs(F.col("pairs")))
    for r in df.select("id", polygons.least_rectangle(F.col("p")).alias("q")).collect():
        q, p = np.array([(c.x, c.y) for c in r.q]), shapes[r.id]
        sides = np.roll(q, -1, 0) - q
        size = np.linalg.norm(sides[0]) * np.linalg.norm(sides[1])
        assert abs(sides[0] @ sides[1]) < 1e-9
        assert size <= plain_rectangle(p) + 1e-9 and size > 0.99 * plain_rectangle(p)
        inward = [np.cross(np.append(s, 0), np.append(x - c, 0))[2] for c, s in zip(q, sides, strict=True) for x in p]
        assert min(np.array(inward) * np.sign(np.cross(np.append(sides[0], 0), np.append(sides[1], 0))[2])) > -1e-9
    one = spark.range(1).select(polygons.least_rectangle(polygons.from_pairs(F.array(*[F.array(F.lit(1.0), F.lit(2.0))] * 3))).alias("q")).first().q
    assert len(one) == 3


def test_contours_become_quads(spark):
    corners = np.array([[0.0, 0.0], [10.0, 1.0], [9.0, 6.0], [1.0, 5.0]])
    dense = [[float(v) for v in a + (b - a) * t / 12] for a, b in zip(corners, np.roll(corners, -1, 0), strict=True) for t in range(12)]
    circle = [[math.cos(t / 20 * math.pi), math.sin(t / 20 * math.pi)] for t in range(40)]
    df = spark.createDataFrame([(1, dense), (2, circle), (3, None), (4, [[0.0, 0.0], [1.0, 1.0]])], "id int, pairs array<array<double>>")
    found = {r.id: r.q for r in contours.contour_quads(df.withColumn("p", polygons.from_pairs(F.col("pairs"))), "p", "q").collect()}
    assert sorted((round(c.x, 6), round(c.y, 6)) for c in found[1]) == sorted(map(tuple, corners.tolist()))
    assert len(found[2]) == 4 and found[3] is None and found[4] is None
    points = np.array(dense)
    for epsilon in (0.01, 0.5, 3.0):
        kept = contours.simplified(points, epsilon)
        assert {tuple(p) for p in points[kept].tolist()} <= {tuple(p) for p in points.tolist()}
        for p in points:  # nothing lies further than epsilon from the outline that is left
            a, b = points[kept], np.roll(points[kept], -1, 0)
            t = np.clip(((p - a) * (b - a)).sum(1) / np.maximum(((b - a) ** 2).sum(1), 1e-30), 0, 1)
            assert np.linalg.norm(p - (a + (b - a) * t[:, None]), axis=1).min() <= epsilon + 1e-9


def test_peaks(spark):
    rng = np.random.default_rng(8)
    maps = rng.normal(size=(5, 9, 4 * 6)).round(1)
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(maps)], "id int, c array<array<double>>")
    found = {}
    for r in df.select("id", F.inline(rasters.peaks(F.col("c"), 4, 6, 0.55))).collect():
        found[r.id, r.y, r.x] = (r.confidence, r.corners)
    expected = {}
    for i, m in enumerate(maps):
        p = 1 / (1 + np.exp(-m[0].reshape(4, 6)))
        for y in range(4):
            for x in range(6):
                if p[y, x] >= 0.55 and p[y, x] >= p[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() - 1e-7:
                    centre = np.tile([(x + 0.5) / 6, (y + 0.5) / 4], 4)
                    expected[i, y, x] = (p[y, x], np.clip(centre + np.tanh(m[1:, y * 6 + x]) * rasters.REACH, 0, 1))
    assert found.keys() == expected.keys() and len(found) > 8
    for k, (confidence, corners) in expected.items():
        assert found[k][0] == pytest.approx(confidence) and found[k][1] == pytest.approx(corners.tolist())


def planted(rng, n, outliers, h):
    points = rng.random((n, 2)) * 400
    moved = np.column_stack([points, np.ones(n)]) @ h.T
    target = moved[:, :2] / moved[:, 2:] + rng.normal(size=(n, 2)) * 0.3
    target[:outliers] = rng.random((outliers, 2)) * 400
    return points, target


def test_planted_homographies_are_found(spark):
    rng = np.random.default_rng(10)
    rows, truth = [], {}
    for pair in range(6):
        h = np.array([[1 + rng.normal() * 0.1, rng.normal() * 0.1, rng.normal() * 20], [rng.normal() * 0.1, 1 + rng.normal() * 0.1, rng.normal() * 20], [rng.normal() * 1e-4, rng.normal() * 1e-4, 1]])
        truth[pair] = h
        a, b = planted(rng, 60, 30, h)
        rows += [(pair, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    rows += [(90, i, float(i), 0.0, 1.0, float(i)) for i in range(5)] + [(91, i, *map(float, rng.random(4) * 400)) for i in range(40)] + [(0, 500, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair long, match_id long, x double, y double, u double, v double")
    found = {r.pair: r for r in registration.register(df, "pair").collect()}
    assert set(found) == {*range(6), 91}
    for pair, h in truth.items():
        assert 28 <= found[pair].inliers <= 36 and found[pair].matches == 60
        grid = np.array([[x, y, 1.0] for x in (0, 200, 400) for y in (0, 200, 400)])
        ours, theirs = grid @ np.reshape(found[pair].homography, (3, 3)).T, grid @ h.T
        assert np.abs(ours[:, :2] / ours[:, 2:] - theirs[:, :2] / theirs[:, 2:]).max() < 4
    assert found[91].ratio < 0.3
    again = {r.pair: r.homography for r in registration.register(df.repartition(7), "pair").collect()}
    assert again == {k: r.homography for k, r in found.items()}
    registered = spark.createDataFrame([(1, t, lay, 60, i, i / 60, [1.0] * 9) for t, lay, i in (("a", "L1", 50), ("b", "L1", 45), ("c", "L2", 30))] + [(2, "a", "L1", 60, 7, 0.9, [1.0] * 9)], "picture long, template string, layout string, matches long, inliers long, ratio double, homography array<double>")
    best = {r.picture: r for r in registration.best_template(registered, "picture", "template", "layout").collect()}
    score, other = 50 * 50 / 60, 30 * 30 / 60
    assert best[1].template == "a" and best[1].confidence == pytest.approx(50 / 80 * 50 / 60 * (0.6 + 0.4 * (1 - other / score)))
    assert best[1].status == "success_with_warnings" and best[2].status == "unsupported_layout"


def test_stability(spark):
    rng = np.random.default_rng(12)
    rows = []
    for frame, n, outliers in ((1, 80, 0), (2, 80, 40), (3, 9, 0), (4, 150, 50)):
        a, b = planted(rng, n, outliers, np.eye(3))
        # the outliers match worst, so those of frame 4 are beyond the first hundred
        rows += [(frame, i, float(n - i), *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "frame long, match_id long, distance double, x double, y double, u double, v double")
    found = {r.frame: r.stability for r in registration.stability(df, "frame").collect()}
    assert found[1] > 0.97 and 0.45 < found[2] < 0.6 and found[3] == 0 and found[4] > 0.97


def test_the_stream_confirms_like_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for camera in range(4):
        spots = [(rng.randrange(100), rng.randrange(100)) for _ in range(6)]
        for no in range(2, 12):
            for i, (x, y) in enumerate(spots):
                if rng.random() < 0.6:
                    x1, y1 = x + rng.random() * 3, y + rng.random() * 3
                    rows.append((camera, no, i, x1, y1, x1 + 10, y1 + 10))
            rows.append((camera, no, 99, 500.0 + 20 * no, 0.0, 505.0 + 20 * no, 5.0))
    schema = "camera long, no long, box_id long, x1 double, y1 double, x2 double, y2 double"
    named = lambda df: df.select("camera", "no", "box_id", boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("box"))
    batch = matching.confirm_tracks(named(spark.createDataFrame(rows, schema)), "camera", "no")
    expected = {(r.camera, r.no, r.box_id): r.confirmed for r in batch.collect()}
    source = f"file://{tmp_path}/in"
    (tmp_path / "in").mkdir()
    stream = confirm_stream(named(spark.readStream.schema(schema).parquet(source)), "camera", "no")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for part in (range(2, 5), range(4, 9), range(9, 12)):  # frame 4 comes twice
            own = [r for r in rows if r[1] in part]
            rng.shuffle(own)
            spark.createDataFrame(own, schema).repartition(3).write.mode("append").parquet(source)
            query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            assert query.awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    found = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(found) == len(expected) and {(r.camera, r.frame_no, r.box_id): r.confirmed for r in found} == expected
    assert len(set(expected.values())) == 2


def test_closing_keeps_runs_not_cells(spark):
    """A wide frame costs a run a row at every step, whatever its number of cells."""
    edges = [(1, 0.0, 0.0, 2999.0, 20.0), (1, -300.0, 40.0, -290.0, 46.0)]
    slots = spark.createDataFrame([(f, i, *b) for i, (f, *b) in enumerate(edges)], "frame long, slot_id long, x1 double, y1 double, x2 double, y2 double").select("frame", "slot_id", boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("box"))
    runs = areas.parking_runs(slots, slots.limit(0).withColumnRenamed("slot_id", "vehicle_id"), "frame", 3.0).collect()
    expected = plain_area([b for _, *b in edges], [], 3.0)
    assert {(x, r.y) for r in runs for x in range(r.a, r.b + 1)} == set().union(*expected)
    assert len(runs) == len({r.y for r in runs}) < 20
