"""Column functions on worked examples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bayline.functions import boxes, hashing, json, numbers, polygons, text, verdicts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def quad(*points):
    return F.array(*(polygons.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


PERSPECTIVE = [(0.10, 0.60), (0.40, 0.55), (0.46, 0.90), (0.06, 0.95)]


def pairs(*points):
    return F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def test_area_of_a_square_and_of_too_few_points(spark):
    assert one(spark, polygons.area(quad((0, 0), (2, 0), (2, 2), (0, 2)))) == 4
    assert one(spark, polygons.area(quad((0, 0), (2, 0)))) == 0


def test_canonical_order_keeps_the_area_whatever_comes_first(spark):
    shuffled = [PERSPECTIVE[i] for i in (2, 0, 3, 1)]
    a, b = (one(spark, polygons.canonical(quad(*p))) for p in (PERSPECTIVE, shuffled))
    assert a == b and (a[0]["x"], a[0]["y"]) == (0.10, 0.60)


@pytest.mark.parametrize(
    ("points", "reason"),
    [
        (PERSPECTIVE, None),
        ([(0.1, 0.1), (0.2, 0.2)], "fewer_than_three_points"),
        ([(0.1, 0.1), (1.2, 0.1), (0.1, 0.3)], "coordinate_out_of_bounds"),
        ([(0.1, 0.1), (0.1001, 0.1), (0.1, 0.1001)], "area_too_small"),
        ([(0.1, 0.1), (math.nan, 0.1), (0.1, 0.3)], "non_finite_coordinate"),
    ],
)
def test_validity(spark, points, reason):
    assert one(spark, polygons.validity(pairs(*points))) == reason


def test_quads_that_are_clearly_sound_need_no_lambda(spark):
    """Before, every polygon went through nested lambdas, which Spark does not compile."""
    rng = random.Random(4)
    near = lambda p, by: [[min(1.2, max(-0.2, v + rng.uniform(-by, by))) for v in q] for q in p]
    square = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    rows = [near(square(rng.random() / 2, rng.random() / 2, w := rng.choice([0.5, 0.1, 1e-2, 4e-3, 1e-5]), w * rng.choice([1, 0.1, 1e-3])), w * rng.choice([0, 0.1, 1, 3])) for _ in range(1500)]
    rows += [rng.sample(p, 4) for p in rows[:500]] + [p[::-1] for p in rows[:500]] + [[[rng.random(), rng.random()] for _ in range(n)] for n in (0, 3, 4, 5) for _ in range(50)]
    good = square(0.1, 0.1, 0.3, 0.2)
    odd = [None, [None, *good[1:]], [[0.1], *good[1:]], [[0.1, 0.1, 0.1], *good[1:]], [[None, 0.1], *good[1:]], [[math.nan, 0.1], *good[1:]], [[0.1, -math.inf], *good[1:]], [[-0.1, 0.1], *good[1:]], [*good[:3], [0.1, 1.1]], [*good, good[0]], [good[0]] * 4]
    df = spark.createDataFrame([(p,) for p in [good, *rows, *odd]], "p array<array<double>>")
    p = F.col("p")
    found = df.select("p", F.coalesce(polygons._clearly_sound(p), F.lit(False)).alias("clear"), polygons._reason(p).alias("reason"), polygons.validity(p).alias("validity")).collect()
    assert all(r.validity == r.reason for r in found)
    assert not any(r.clear and r.reason for r in found) and not any(r.clear for r in found[-len(odd) :])
    turns = lambda p: [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in (((p * 2)[i : i + 3]) for i in range(4))]
    wide = lambda p: all(0 <= v <= 1 for q in p for v in q) and (min(turns(p)) > 2e-5 or max(turns(p)) < -2e-5)
    assert all(r.clear == wide(r.p) for r in found[: -len(odd)] if len(r.p) == 4)
    assert found[0].clear and sum(r.reason is None for r in found) > sum(r.clear for r in found) > 400
    assert "lambda" not in df.select(polygons._clearly_sound(p))._jdf.queryExecution().optimizedPlan().toString()


def test_self_intersection(spark):
    assert one(spark, polygons.self_intersects(quad((0, 0), (1, 1), (1, 0), (0, 1))))
    assert not one(spark, polygons.self_intersects(quad((0, 0), (1, 0), (1, 1), (0, 1))))


def test_quads_are_accepted_by_extent_and_bounds(spark):
    assert one(spark, polygons.acceptable_quad(pairs((0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2))))
    assert not one(spark, polygons.acceptable_quad(pairs((0.1, 0.1), (0.2, 0.1), (0.2, 0.2))))
    assert not one(spark, polygons.acceptable_quad(pairs(*[(0.1, 0.1)] * 4)))
    assert not one(spark, polygons.acceptable_quad(pairs((-0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2))))


def test_clip_agrees_with_boxes_in_either_orientation(spark):
    a, b = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)]
    for p in (a, a[::-1]):
        for q in (b, b[::-1]):
            assert one(spark, polygons.iou(quad(*p), quad(*q))) == pytest.approx(4 / 28)
    assert one(spark, polygons.iou(quad(*a), quad((5, 5), (6, 5), (6, 6)))) == 0
    diamond = quad((2, -1), (5, 2), (2, 5), (-1, 2))
    assert one(spark, polygons.area(polygons.clip(quad(*a), diamond))) == pytest.approx(14)


def test_points_on_the_edge_are_inside(spark):
    square = quad((0, 0), (2, 0), (2, 2), (0, 2))
    inside = lambda x, y: one(spark, polygons.contains(square, F.lit(float(x)), F.lit(float(y))))
    assert inside(1, 1) and inside(0, 1) and inside(2, 2) and not inside(3, 1)


def test_corner_error_takes_the_best_turn(spark):
    a = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert one(spark, polygons.corner_error(quad(*a[2:], *a[:2]), quad(*a))) == 0


def test_boxes(spark):
    box = lambda *e: boxes.box(*(F.lit(float(v)) for v in e))
    assert one(spark, boxes.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, boxes.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, boxes.footprint(box(0, 0, 2, 10)).y1) == pytest.approx(5.5)
    assert one(spark, boxes.coverage(box(0, 0, 0, 0), box(0, 0, 1, 1)).first) == 0


def test_hash_scores_match_plain_sha256(spark):
    import hashlib

    for key in ("a", "b/1", "ü"):
        digest = hashlib.sha256(f"7|{key}".encode()).hexdigest()
        assert one(spark, hashing.score(F.lit(key), 7)) == digest
        assert one(spark, hashing.score_mod(F.lit(key), 7, 1000)) == int(digest, 16) % 1000


@pytest.mark.parametrize(("a", "b", "bits"), [("0" * 16, "0" * 16, 0), ("f" * 16, "0" * 16, 64), ("8" + "0" * 15, "0" * 15 + "1", 2), ("zz", "0" * 16, 64)])
def test_hamming(spark, a, b, bits):
    assert one(spark, hashing.hamming_hex64(F.lit(a), F.lit(b))) == bits


def test_text_keys(spark):
    assert one(spark, text.slug(F.lit("  Hello, World! 42 "))) == "hello-world-42"
    assert one(spark, text.capture_key(F.lit("UFPR05/Sunny/2013-02-22/2013-02-22_06_15_00"))) == "2013-02-220615"
    assert one(spark, text.safe_name(F.lit("a/b c*?.png"))) == "b c_.png" and one(spark, text.safe_name(F.lit("../..."))) == "upload"
    assert one(spark, text.capture_stem(F.lit("2015-11-12_07.09"))) == "2015-11-12_0709"
    assert [one(spark, text.occupancy_label(F.lit(v))) for v in (" 1", "0", "", "x")] == [True, False, None, None]
    assert one(spark, text.safe_relative_path(F.lit("a/b.png"))) and not one(spark, text.safe_relative_path(F.lit("a/../b")))
    assert one(spark, text.camera_identity(F.lit("PKLot"), F.lit("PUCPR/2012-09-12"), F.lit("x"))) == "PKLot:PUCPR"
    assert one(spark, text.vehicle_class(F.lit(" Lorry "))) == "TRUCK" and one(spark, text.vehicle_class(F.lit("bus"))) is None


def test_malformed_json_is_an_empty_list(spark):
    for bad in ("not json", "{}", "[]", None):
        assert one(spark, json.json_elements(F.lit(bad).cast("string"))) == []
    element = one(spark, json.json_elements(F.lit('[{"a": null, "b": 0}]')))[0]
    assert one(spark, json.has_key(F.lit(element), "a")) and not one(spark, json.has_key(F.lit(element), "c"))
    truthy = lambda t: one(spark, json.truthy(F.lit(t), "k"))
    assert [truthy(t) for t in ('{"k": true}', '{"k": 1}', '{"k": "x"}', '{"k": false}', '{"k": 0}', '{"k": null}', "{}", '{"k": ""}')] == [True] * 3 + [False] * 5


def fused(spark, p, weights, **evidence):
    columns = {k: F.lit(v) for k, v in evidence.items()}
    return one(spark, verdicts.fuse(verdicts.contributions(F.lit(p), weights, **columns), weights))


def test_default_fusion_is_the_classifier(spark):
    for p in (0.02, 0.3, 0.5, 0.8, 0.99):
        assert fused(spark, p, verdicts.DEFAULT_WEIGHTS) == pytest.approx(p, abs=1e-6)


def test_fusion_evidence_moves_verdicts(spark):
    base = verdicts.DEFAULT_WEIGHTS
    state = lambda q: one(spark, verdicts.open_band(F.lit(q), 0.35, 0.65))
    present = base | {"vehicle_present": 2.0, "vehicle_absent": -0.8}
    assert state(fused(spark, 0.985, present, available=True)) == "occupied"
    assert state(fused(spark, 0.80, present, available=True)) != "vacant"
    absent = base | {"vehicle_absent": -1.5}
    assert fused(spark, 0.7, absent) > fused(spark, 0.7, absent, available=True)
    geometry = base | {"geometry_confidence": 1.5}
    assert fused(spark, 0.72, geometry, geometry=0.4) < fused(spark, 0.72, geometry, geometry=1.0)
    w = verdicts.FITTED_WEIGHTS
    assert state(fused(spark, 0.95, w, available=True, detected=True, confidence=0.85, slot_share=0.7, vehicle_share=0.9)) == "occupied"
    assert state(fused(spark, 0.30, w, available=True, detected=True, confidence=0.9, slot_share=0.9, vehicle_share=0.95)) != "vacant"
    assert state(fused(spark, 0.92, w, available=True)) == "occupied"


def test_band_edges(spark):
    closed = lambda p: one(spark, verdicts.closed_band(F.lit(p), 0.35, 0.65, 0.5))
    opened = lambda p: one(spark, verdicts.open_band(F.lit(p), 0.35, 0.65))
    assert [closed(0.35), closed(0.65), closed(0.66), closed(0.3)] == ["uncertain", "uncertain", "occupied", "vacant"]
    assert [opened(0.35), opened(0.65), opened(0.5)] == ["vacant", "occupied", "uncertain"]


def test_frame_verdicts(spark):
    rows = [(0.02, False), (0.45, False), (0.50, True), (0.55, True), (0.97, True), (0.30, False), (0.80, True)]
    frame = spark.createDataFrame(rows, "p double, s boolean")
    states = [r.v for r in frame.select(verdicts.smoothed_verdict(F.col("p"), F.col("s"), 0.35, 0.56).alias("v")).collect()]
    assert states.count("uncertain") == 3 and len(states) == 7


def test_calibration_bin_keeps_one_in_the_last_bin(spark):
    assert [one(spark, numbers.calibration_bin(F.lit(c))) for c in (0.0, 0.55, 0.999, 1.0)] == [0, 5, 9, 9]


def test_camera_splits(spark):
    split = lambda d, i, p: hashing.camera_split(F.lit(d), F.col("id").cast("string") if i is None else F.lit(i), F.lit(p), 7)
    assert one(spark, split("PKLot", "a", "validation")) == "val_unseen" and one(spark, split("PKLot", "a", "holdout")) == "test_unseen"
    assert one(spark, split("ACPDS", "a", "train")) == "train"
    held = spark.range(400).select(split("PKLot", None, "train").alias("s")).where("s = 'val_known'").count()
    assert abs(held / 400 - 0.15) < 0.08
