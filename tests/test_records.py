"""Splits, diverse choices and functions that no query shows, against plain versions."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from bayline.functions import boxes, numbers, polygons, text
from bayline.operators import layouts, matching, sampling, verification
from bayline.sources import annotations


def plain_diverse(rows, n):
    """Picks one by one: new conditions, then new lots, then the least chosen of both."""
    taken = []
    while len(taken) < min(n, len(rows)):
        conditions, lots = (collections.Counter(r[i] for r in taken) for i in (1, 2))
        key = lambda r: (0, r[1], lots[r[2]] > 0, r[0]) if not conditions[r[1]] else (1, r[2], r[0]) if not lots[r[2]] else (2, lots[r[2]], conditions[r[1]], r[0])  # noqa: B023, E731
        taken.append(min((r for r in rows if r not in taken), key=key))
    return [r[0] for r in taken]


@pytest.mark.parametrize("n", [2, 5, 12, 200])
def test_diverse_selection(spark, n):
    rng = random.Random(n)
    rows = [(i, f"c{rng.randrange(3)}", f"l{min(rng.randrange(6), rng.randrange(6))}", f"g{i % 2}") for i in range(80)]
    found = sampling.diverse(spark.createDataFrame(rows, "id long, condition string, lot string, grp string"), "grp", "condition", "lot", "id", n).collect()
    for g in ("g0", "g1"):
        assert [r.id for r in sorted((r for r in found if r.grp == g), key=lambda r: r.place)] == plain_diverse([r[:3] for r in rows if r[3] == g], n)


def test_split_lists(spark, tmp_path):
    (tmp_path / "train.txt").write_text("PKLot/puc/Sunny/2012-09-11/a.jpg 1\nPKLot/UFPR04/Rainy/2012-12-07/b.jpg 0\nno day here\nPKLot/other/2012-01-01/c.jpg\n")
    (tmp_path / "test.txt").write_text("PKLot/PUCPR/Sunny/2012-09-11/z.jpg\nPKLot/ufpr05/Sunny/2013-03-01/q.jpg\n")
    found = {tuple(r) for r in annotations.split_lists(spark, f"file://{tmp_path}").collect()}
    assert found == {("PUCPR", "2012-09-11", "holdout"), ("UFPR04", "2012-12-07", "train"), ("UFPR05", "2013-03-01", "holdout")}
    days = {tuple(r) for r in annotations.split_lists(spark, f"file://{tmp_path}", sites=False).collect()}
    assert ("day", "2012-01-01", "train") in days and len(days) == 4


def test_clamped_slots(spark):
    rows = spark.createDataFrame([("a", "1", True, [[-5.0, 10.0], [50.0, 300.0]]), ("a", "2", None, [[1.0, 1.0]])], "path string, slot_id string, occupied boolean, pairs array<array<double>>")
    assert [r.pairs for r in annotations.clamped_slots(rows, 100, 200).collect()] == [[[0.0, 0.05], [0.5, 1.0]]]


def test_geometry_functions(spark):
    one = spark.range(1)
    x = lambda *v: [F.lit(float(a)) for a in v]
    turned = one.select(polygons.rotated_box(*x(1, 2, 4, 2, math.pi / 2)).alias("q")).first().q
    assert [(round(p.x, 6), round(p.y, 6)) for p in turned] == [(2, 0), (2, 4), (0, 4), (0, 0)]
    point = lambda a, b: polygons.point(*x(a, b))
    met = one.select(polygons.line_intersection(point(0, 0), point(2, 2), point(0, 2), point(2, 0)).alias("p"), polygons.line_intersection(point(0, 0), point(1, 1), point(0, 1), point(1, 2)).alias("none")).first()
    assert (met.p.x, met.p.y) == (1, 1) and met.none is None
    back = one.select(boxes.unletterbox(boxes.box(*x(20, 10, 120, 60)), *x(0.5, 20, 10, 400, 100)).alias("b")).first().b
    assert tuple(back) == (0, 0, 0.5, 1)
    assert one.select(numbers.tempered_sigmoid(F.lit(3.0), F.lit(1.5)).alias("p")).first().p == pytest.approx(1 / (1 + math.exp(-2)))


def test_capture_keys_anywhere(spark):
    rows = spark.createDataFrame([("cam/2015-11-12/07.09/x.jpg",), ("none",)], "s string")
    found = [r.k for r in rows.select(text.capture_key(F.col("s"), text.CAPTURE_ANYWHERE).alias("k")).collect()]
    assert found == ["2015-11-120709", "none"]


def test_a_layout_that_nothing_corroborates_reports_the_detected_slots(spark):
    rows = [("a", 0.1, 9, 5, 0.9, False, True), ("b", 0.5, 9, 5, 0.9, False, True), ("c", None, 9, 5, 0.9, False, False), ("d", 0.1, 9, 5, 0.9, True, True)]
    df = spark.createDataFrame(rows, "id string, agreement double, recalled int, detected int, confidence double, verified boolean, detector boolean")
    found = {r.id: r.usable for r in layouts.choose_layout(df).collect()}
    assert set(found) == set("abcd")
    none = layouts.choose_layout(df.where("id = 'a'").withColumn("detected", F.lit(0))).first()
    assert none.state == "insufficient_visual_evidence" and not none.usable


def test_polygon_suppression_limits_and_ties(spark):
    square = lambda a, b: [(float(x), float(y)) for x, y in ((a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1))]
    rows = [(1, 1, 0.9, square(0, 0)), (1, 2, 0.9, square(0.1, 0)), (1, 3, 0.5, square(3, 3)), (1, 4, 0.4, square(6, 6)), (1, 5, 0.3, square(9, 9)), (2, 1, 0.1, square(0, 0))]
    df = spark.createDataFrame(rows, "frame long, box_id long, score double, polygon array<struct<x:double,y:double>>")
    assert sorted((r.frame, r.box_id) for r in matching.suppress_polygons(df, "frame", 0.5, 3).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_faults_of_a_catalogue_against_plain_rules(spark):
    """Near copies of lesser ids, slots of every shape, and what is missing."""
    rng = random.Random(12)
    bits = [3 << 40 | rng.getrandbits(12) for _ in range(60)]
    rows = [(i, f"d{i % 7 % 3}", i % 4, i % 2, None if i % 11 == 0 else f"{i - i % 13 % 2:064x}", None if i % 17 == 0 else f"{bits[i]:016x}") for i in range(60)]
    square = [[0.1, 0.1], [0.4, 0.1], [0.4, 0.3], [0.1, 0.3]]
    shapes = [(square, False), (square[::-1], False), ([square[i] for i in (0, 2, 1, 3)], False), (None, True), (square[:2], True), ([*square[:3], [0.1, 1.5]], True), ([*square[:3], [0.1]], True), ([[0.1, 0.1], [0.1001, 0.1], [0.1001, 0.1001], [0.1, 0.1001]], True)]
    slots = [(i, rng.random() < 0.5, *rng.choice(shapes[:3] if i % 3 else shapes)) for i in range(5, 60) for _ in range(i % 4 + 1)]
    scenarios = spark.createDataFrame(rows, "id long, dataset string, total long, occupied long, digest string, hash string")
    found = verification.verify_catalogue(scenarios, spark.createDataFrame([s[:3] for s in slots], "id long, occupied boolean, pairs array<array<double>>"), ["d0", "d9"], 20).collect()
    expected = [("d9", "missing_dataset")] + [(d, "below_minimum") for d in ("d0", "d1", "d2") if sum(r[1] == d for r in rows) < 20]
    for i, _, total, occupied, digest, hashed in rows:
        own = [s for s in slots if s[0] == i]
        reasons = {
            "no_slots": not own, "slot_total_mismatch": own and len(own) != total, "occupied_total_mismatch": own and sum(s[1] for s in own) != occupied, "invalid_polygon": any(s[3] for s in own),
            "missing_source_hash": digest is None, "missing_perceptual_hash": hashed is None, "exact_duplicate": digest and any(r[4] == digest for r in rows[:i]),
            "near_duplicate": hashed and any(r[5] and (int(r[5], 16) ^ bits[i]).bit_count() <= 1 for r in rows[:i]),
        }
        expected += [(str(i), reason) for reason, holds in reasons.items() if holds]
    assert sorted(map(tuple, found)) == sorted(expected) and {"near_duplicate", "invalid_polygon", "exact_duplicate"} <= {r for _, r in expected}
