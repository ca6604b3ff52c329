"""Queries over scenes: an order is a frame, its lineitems are slots or vehicles with derived boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions import boxes, polygons
from bayline.functions.text import vehicle_class
from bayline.operators import matching, metrics
from bayline.plans.registry import Registry
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: frame, box_id, score, label, whether it is a slot, and its edges."""
    c = F.col
    x1, y1 = (c("l_partkey") % 7 * 4).cast("double"), (c("l_suppkey") % 5 * 4).cast("double")
    box = boxes.box(x1, y1, x1 + 10 + c("l_quantity") % 10, y1 + 10 + c("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("frame"),
        (c("l_partkey") * 10000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("box_id"),
        (c("l_discount") + c("l_tax") / 10).alias("score"),
        c("l_returnflag").alias("label"),
        (c("l_linestatus") == "F").alias("is_slot"),
        box.alias("box"),
    )


ITEMS = """
WITH items AS (
  SELECT l_orderkey AS frame, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS box_id, l_discount + l_tax / 10 AS score, l_returnflag AS label,
         l_linestatus = 'F' AS is_slot, CAST(l_partkey % 7 * 4 AS DOUBLE) AS x1, CAST(l_suppkey % 5 * 4 AS DOUBLE) AS y1,
         l_partkey % 7 * 4 + 10 + l_quantity % 10 AS x2, l_suppkey % 5 * 4 + 10 + l_linenumber AS y2
  FROM lineitem)
"""
_COMMON = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
_IOU = f"({_COMMON} / ({_AREA.format('a')} + {_AREA.format('b')} - {_COMMON}))"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("is_slot").select("frame", F.col("box_id").alias("slot_id"), "box")


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("not is_slot").select("frame", F.col("box_id").alias("vehicle_id"), "box", "label")


@_R.add("box_iou_pairs", ITEMS + f"SELECT a.frame, a.box_id AS a, b.box_id AS b, round({_IOU}, 6) AS iou FROM items a JOIN items b ON a.frame = b.frame AND a.box_id < b.box_id WHERE {_IOU} >= 0.3")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a frame that overlap by 0.3."""
    rows = items(spark, sf_dir)
    a = rows.select("frame", F.col("box_id").alias("a"), F.col("box").alias("box_a"))
    b = rows.select("frame", F.col("box_id").alias("b"), F.col("box").alias("box_b"))
    overlap = boxes.iou(F.col("box_a"), F.col("box_b"))
    return a.join(b, "frame").where("a < b").withColumn("iou", overlap).where("iou >= 0.3").select("frame", "a", "b", F.round("iou", 6).alias("iou"))


LINKS = ITEMS + f"""
, a AS (SELECT frame, box_id AS slot_id, x1, y1, x2, y2 FROM items WHERE is_slot),
b AS (SELECT frame, box_id AS vehicle_id, x1, y2 - (y2 - y1) * 0.45 AS y1, x2, y2 FROM items WHERE NOT is_slot),
l AS (SELECT a.frame, slot_id, vehicle_id, {_COMMON} / {_AREA.format('a')} AS slot_coverage, {_COMMON} / {_AREA.format('b')} AS vehicle_coverage,
             (b.x1 + b.x2) / 2 BETWEEN a.x1 AND a.x2 AND (b.y1 + b.y2) / 2 BETWEEN a.y1 AND a.y2 AS centroid_inside FROM a JOIN b ON a.frame = b.frame),
links AS (SELECT *, greatest(slot_coverage, vehicle_coverage) >= 0.35 AS occupies FROM l WHERE greatest(slot_coverage, vehicle_coverage) >= 0.10)
"""


@_R.add("coverage_links", LINKS + "SELECT frame, slot_id, vehicle_id, round(slot_coverage, 6) AS slot_coverage, round(vehicle_coverage, 6) AS vehicle_coverage, centroid_inside, occupies FROM links")
def coverage_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of slots and the vehicles standing on them."""
    found = matching.link_boxes(_slots(spark, sf_dir), _vehicles(spark, sf_dir), "frame")
    return found.withColumns({c: F.round(c, 6) for c in ("slot_coverage", "vehicle_coverage")})


@_R.add("best_link_per_slot", LINKS + "SELECT frame, slot_id, arg_max(vehicle_id, (slot_coverage, -vehicle_id)) AS vehicle_id, round(max(slot_coverage), 6) AS slot_coverage FROM links GROUP BY frame, slot_id")
def best_link_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle that covers most of each slot."""
    found = matching.link_boxes(_slots(spark, sf_dir), _vehicles(spark, sf_dir), "frame")
    return matching.best_links(found, "frame").select("frame", "slot_id", "vehicle_id", F.round("slot_coverage", 6).alias("slot_coverage"))


@_R.add("unmapped_vehicles", LINKS + "SELECT frame, vehicle_id FROM b WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.frame = b.frame AND k.vehicle_id = b.vehicle_id AND occupies)")
def unmapped_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles that occupy no slot."""
    vehicles = _vehicles(spark, sf_dir)
    found = matching.link_boxes(_slots(spark, sf_dir), vehicles, "frame")
    return matching.unmapped(vehicles, found, "frame").select("frame", "vehicle_id")


@_R.add(
    "polygon_links_agree",
    LINKS + "SELECT frame, slot_id, vehicle_id, round(slot_coverage + 1e-7, 4) AS slot_coverage FROM links WHERE greatest(slot_coverage, vehicle_coverage) > 0.1001",
)
def polygon_links_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links through convex clipping; those a hair above the least coverage are left to the other query."""
    slots = _slots(spark, sf_dir).withColumn("polygon", boxes.to_quad(F.col("box"))).drop("box")
    found = matching.link_polygons(slots, _vehicles(spark, sf_dir), "frame").where(F.greatest("slot_coverage", "vehicle_coverage") > 0.1001)
    return found.select("frame", "slot_id", "vehicle_id", F.round(F.col("slot_coverage") + 1e-7, 4).alias("slot_coverage"))


_AGREE = ITEMS + f"""
, d AS (SELECT a.frame, a.box_id, bool_or(b.box_id IS NOT NULL AND {_IOU} >= {{at}}) AS hit FROM items a LEFT JOIN items b ON a.frame = b.frame AND b.is_slot WHERE NOT a.is_slot GROUP BY 1, 2)
SELECT frame, count(*) AS detected, round({{share}}, 6) AS agreement FROM d GROUP BY frame
"""


@_R.add("layout_agreement", _AGREE.format(at=0.30, share="CASE WHEN count(*) >= 5 THEN avg(CAST(coalesce(hit, FALSE) AS INTEGER)) ELSE 0 END"))
def layout_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a frame's detections that its layout explains, zero with fewer than five."""
    detected = _vehicles(spark, sf_dir).withColumnRenamed("vehicle_id", "box_id")
    found = matching.explained_share(detected, _slots(spark, sf_dir), "frame", 0.30, 5)
    return found.withColumn("agreement", F.round("agreement", 6))


@_R.add("drift_check", _AGREE.format(at=0.45, share="avg(CAST(coalesce(hit, FALSE) AS INTEGER))").replace("AS agreement", "AS agreement, avg(CAST(coalesce(hit, FALSE) AS INTEGER)) >= 0.15 AS still_describes"))
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored layout still describes a frame."""
    detected = _vehicles(spark, sf_dir).withColumnRenamed("vehicle_id", "box_id")
    found = matching.explained_share(detected, _slots(spark, sf_dir), "frame", 0.45)
    return found.select("frame", "detected", F.round("agreement", 6).alias("agreement"), (F.col("agreement") >= 0.15).alias("still_describes"))


@_R.add("nearest_half_iou", ITEMS + f", m AS (SELECT a.frame, a.box_id, max({_IOU}) AS best FROM items a JOIN items b ON a.frame = b.frame AND a.is_slot AND NOT b.is_slot GROUP BY 1, 2) SELECT count(*) AS slots, round(avg(CAST(best >= 0.5 AS INTEGER)), 6) AS agreed, round(quantile_cont(best, 0.5), 6) AS median_iou FROM m")
def nearest_half_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well two halves of a calibration agree: each slot's nearest one in the other half."""
    a = _slots(spark, sf_dir).select("frame", "slot_id", F.col("box").alias("a"))
    b = _vehicles(spark, sf_dir).select("frame", F.col("box").alias("b"))
    best = a.join(b, "frame").groupBy("frame", "slot_id").agg(F.max(boxes.iou(F.col("a"), F.col("b"))).alias("best"))
    counts = best.agg(F.count("*").alias("slots"), F.round(F.avg((F.col("best") >= 0.5).cast("double")), 6).alias("agreed"))
    return counts.crossJoin(metrics.medians(best, [], "best", "m").select(F.round("m", 6).alias("median_iou")))  # one row each


@_R.add(
    "detection_confirmation",
    ITEMS
    + f"""
, f AS (SELECT CAST(frame % 100 AS BIGINT) AS camera, CAST(floor(frame / 100) AS BIGINT) AS no, box_id, x1, y1, x2, y2 FROM items),
s AS (SELECT a.camera, a.no, a.box_id, count(DISTINCT b.no) AS before FROM f a JOIN f b ON a.camera = b.camera AND b.no BETWEEN a.no - 3 AND a.no - 1 WHERE {_IOU} >= 0.45 GROUP BY ALL)
SELECT f.camera, f.no, f.box_id, f.no - min(f.no) OVER (PARTITION BY f.camera) < 1 OR coalesce(s.before, 0) + 1 >= 2 AS confirmed
FROM f LEFT JOIN s ON f.camera = s.camera AND f.no = s.no AND f.box_id = s.box_id
""",
)
def detection_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that recur in the three frames before."""
    rows = items(spark, sf_dir).select((F.col("frame") % 100).alias("camera"), F.floor(F.col("frame") / 100).alias("no"), "box_id", "box")
    return matching.confirm_tracks(rows, "camera", "no")


@_R.add(
    "aabb_nms",
    ITEMS.replace("WITH", "WITH RECURSIVE")
    + f"""
, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id) AS n FROM items),
hit AS (SELECT a.frame, a.n, list(b.n) AS over FROM o a JOIN o b ON a.frame = b.frame AND b.n < a.n WHERE {_IOU} >= 0.45 GROUP BY ALL),
q AS (SELECT o.frame, o.n, coalesce(over, []) AS over FROM o LEFT JOIN hit ON o.frame = hit.frame AND o.n = hit.n),
walk AS (
  SELECT frame, n, [n] AS kept FROM q WHERE n = 1
  UNION ALL SELECT q.frame, q.n, CASE WHEN len(list_intersect(kept, over)) > 0 THEN kept ELSE list_append(kept, q.n) END FROM walk w JOIN q ON q.frame = w.frame AND q.n = w.n + 1),
k AS (SELECT frame, unnest(arg_max(kept, n)) AS n FROM walk GROUP BY frame)
SELECT frame, box_id, score FROM k JOIN o USING (frame, n)
""",
)
def aabb_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that greedy suppression at 0.45 keeps."""
    return matching.suppress(items(spark, sf_dir), "frame", 0.45)


@_R.add(
    "polygon_nms",
    ITEMS.replace("WITH", "WITH RECURSIVE")
    + f"""
, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id) AS n FROM items),
hit AS (SELECT a.frame, a.n, list(b.n) AS over FROM o a JOIN o b ON a.frame = b.frame AND b.n < a.n WHERE {_IOU} >= 0.30001 GROUP BY ALL),
q AS (SELECT o.frame, o.n, coalesce(over, []) AS over FROM o LEFT JOIN hit ON o.frame = hit.frame AND o.n = hit.n),
walk AS (
  SELECT frame, n, [n] AS kept FROM q WHERE n = 1
  UNION ALL SELECT q.frame, q.n, CASE WHEN len(kept) >= 3 OR len(list_intersect(kept, over)) > 0 THEN kept ELSE list_append(kept, q.n) END FROM walk w JOIN q ON q.frame = w.frame AND q.n = w.n + 1),
k AS (SELECT frame, unnest(arg_max(kept, n)) AS n FROM walk GROUP BY frame)
SELECT frame, box_id, score FROM k JOIN o USING (frame, n)
""",
)
def polygon_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals that greedy suppression keeps, three of a frame at most."""
    rows = items(spark, sf_dir).withColumn("polygon", boxes.to_quad(F.col("box")))
    return matching.suppress_polygons(rows, "frame", 0.30001, 3)


def matched(spark: SparkSession, sf_dir: str, at: float = 0.3, **how) -> DataFrame:
    """Vehicles matched to slots, as predictions and truth."""
    rows = items(spark, sf_dir)
    return matching.match(rows.where("not is_slot"), rows.where("is_slot"), "frame", at, **how)


def matched_sql(at: float = 0.3, truth_order: str = "DESC") -> str:
    """The same by a recursive walk over each frame's predictions, as relation m."""
    return ITEMS.replace("WITH", "WITH RECURSIVE") + f"""
, p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id) AS n FROM items WHERE NOT is_slot),
c AS (SELECT a.frame, a.n, list(b.box_id ORDER BY {_IOU} DESC, b.box_id {truth_order}) AS cands FROM p a JOIN items b ON a.frame = b.frame AND b.is_slot WHERE {_IOU} >= {at} GROUP BY a.frame, a.n),
q AS (SELECT p.frame, p.n, coalesce(cands, []) AS cands FROM p LEFT JOIN c ON p.frame = c.frame AND p.n = c.n),
walk AS (
  SELECT frame, n, cands[1] AS truth, [cands[1]] AS taken FROM q WHERE n = 1
  UNION ALL SELECT frame, n, truth, list_append(taken, truth) FROM (
    SELECT q.frame, q.n, w.taken, list_filter(q.cands, lambda x: NOT list_contains(w.taken, x))[1] AS truth FROM walk w JOIN q ON q.frame = w.frame AND q.n = w.n + 1)),
hits AS (SELECT p.frame, p.box_id AS predicted_id, truth AS truth_id FROM walk JOIN p USING (frame, n)),
m AS (
  SELECT h.frame, a.box_id AS predicted_id, b.box_id AS truth_id, {_IOU} AS overlap, a.score AS predicted_score, b.score AS truth_score,
         (sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) + sqrt((a.x2 - b.x2) ** 2 + (a.y1 - b.y1) ** 2) + sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) + sqrt((a.x1 - b.x1) ** 2 + (a.y2 - b.y2) ** 2)) / 4 AS corner_error
  FROM hits h JOIN items a ON a.frame = h.frame AND a.box_id = h.predicted_id AND NOT a.is_slot LEFT JOIN items b ON b.frame = h.frame AND b.box_id = h.truth_id AND b.is_slot
  UNION ALL
  SELECT frame, NULL, box_id, NULL, NULL, score, NULL FROM items t WHERE is_slot AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.frame = t.frame AND h.truth_id = t.box_id))
"""


_PAIRS = "SELECT frame, predicted_id, truth_id, round(overlap, 6) AS overlap FROM m"


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("frame", "predicted_id", "truth_id", F.round("overlap", 6).alias("overlap"))


@_R.add("greedy_match_a", matched_sql() + _PAIRS)
def greedy_match_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by score take the best truth left, the last of equals."""
    return _pairs(matched(spark, sf_dir, tie="last"))


@_R.add(
    "greedy_match_b",
    ITEMS.replace("WITH", "WITH RECURSIVE")
    + f"""
, p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id) AS r FROM items WHERE NOT is_slot),
c AS (SELECT a.frame, a.box_id AS predicted_id, b.box_id AS truth_id, {_IOU} AS overlap, row_number() OVER (PARTITION BY a.frame ORDER BY {_IOU} DESC, a.r, b.box_id) AS n
      FROM p a JOIN items b ON a.frame = b.frame AND b.is_slot WHERE {_IOU} >= 0.3),
walk AS (
  SELECT frame, n, [predicted_id] AS ps, [truth_id] AS ts, TRUE AS hit FROM c WHERE n = 1
  UNION ALL SELECT frame, n, CASE WHEN hit THEN list_append(ps, predicted_id) ELSE ps END, CASE WHEN hit THEN list_append(ts, truth_id) ELSE ts END, hit FROM (
    SELECT c.*, ps, ts, NOT list_contains(ps, predicted_id) AND NOT list_contains(ts, truth_id) AS hit FROM walk w JOIN c ON c.frame = w.frame AND c.n = w.n + 1)),
hits AS (SELECT frame, predicted_id, truth_id, overlap FROM walk JOIN c USING (frame, n) WHERE hit)
SELECT i.frame, i.box_id AS predicted_id, truth_id, round(overlap, 6) AS overlap FROM items i LEFT JOIN hits h ON h.frame = i.frame AND h.predicted_id = i.box_id WHERE NOT is_slot
UNION ALL SELECT frame, NULL, box_id, NULL FROM items t WHERE is_slot AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.frame = t.frame AND h.truth_id = t.box_id)
""",
)
def greedy_match_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs by falling overlap."""
    return _pairs(matched(spark, sf_dir, order="by_overlap"))


@_R.add("greedy_match_c", matched_sql(truth_order="ASC") + _PAIRS)
def greedy_match_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by score take the best truth left, the first of equals."""
    return _pairs(matched(spark, sf_dir))


@_R.add(
    "calibrated_layouts",
    ITEMS.replace("WITH", "WITH RECURSIVE")
    + """
, d AS (SELECT frame % 5 AS camera, CAST(floor(frame / 1000) AS BIGINT) AS run, CAST(floor(frame / 100) AS BIGINT) AS no, x1, y1, x2, y2, score,
               row_number() OVER (PARTITION BY frame % 5, floor(frame / 1000) ORDER BY floor(frame / 100), box_id, x1, y1, x2, y2, score) AS n FROM items WHERE is_slot),
walk AS (
  SELECT camera, run, n, [{'a': x1, 'b': y1, 'c': x2, 'd': y2, 's': score, 'n': 1::BIGINT, 'no': -1::BIGINT}] AS tracks FROM d WHERE n = 1
  UNION ALL
  SELECT camera, run, n, CASE WHEN best IS NULL THEN list_append(tracks, {'a': x1, 'b': y1, 'c': x2, 'd': y2, 's': score, 'n': 1::BIGINT, 'no': -1::BIGINT})
    ELSE [CASE WHEN i = best.i THEN {'a': t.a + x1, 'b': t.b + y1, 'c': t.c + x2, 'd': t.d + y2, 's': t.s + score, 'n': t.n + 1, 'no': no} ELSE t END FOR t, i IN tracks] END
  FROM (
    SELECT camera, run, n, tracks, x1, y1, x2, y2, score, no, list_filter(list_sort([{
      'o': -round(greatest(least(x2, t.c / t.n) - greatest(x1, t.a / t.n), 0) * greatest(least(y2, t.d / t.n) - greatest(y1, t.b / t.n), 0)
        / ((x2 - x1) * (y2 - y1) + (t.c - t.a) / t.n * (t.d - t.b) / t.n - greatest(least(x2, t.c / t.n) - greatest(x1, t.a / t.n), 0) * greatest(least(y2, t.d / t.n) - greatest(y1, t.b / t.n), 0)), 9),
      'i': i} FOR t, i IN tracks IF t.no <> no]), lambda x: -x.o >= 0.45)[1] AS best
    FROM (SELECT d.*, w.tracks FROM walk w JOIN d ON d.camera = w.camera AND d.run = w.run AND d.n = w.n + 1))),
last AS (SELECT camera, run, arg_max(tracks, n) AS tracks FROM walk GROUP BY ALL),
f AS (SELECT camera, run, count(DISTINCT no) AS frames FROM d GROUP BY ALL),
t AS (SELECT camera, run, frames, unnest(tracks) AS t, unnest(range(len(tracks))) AS i FROM last JOIN f USING (camera, run)),
k AS (SELECT *, count(*) OVER (PARTITION BY camera, run) AS slots, row_number() OVER (PARTITION BY camera, run ORDER BY t.n DESC, i) AS slot_id FROM t WHERE t.n >= greatest(2, round_even(0.6 * frames, 0)))
SELECT camera, run, slot_id, t.n AS frames_seen, frames, round(t.s / t.n, 6) AS confidence, round(t.a / t.n, 6) AS x1, round(t.b / t.n, 6) AS y1, round(t.c / t.n, 6) AS x2, round(t.d / t.n, 6) AS y2 FROM k WHERE slots >= 4
""",
)
def calibrated_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that recur in six tenths of ten frames of a camera, of each run of ten frames; a hundred orders make a frame, and all are read."""
    no = F.floor(F.col("frame") / 100)
    key = F.floor(no / 10) * 5 + F.col("frame") % 5
    rows = items(spark, sf_dir).where("is_slot").select(key.alias("key"), no.alias("no"), "box_id", "score", "box")
    found = matching.calibrate(rows, "key", "no")
    edges = [F.round(F.col("box")[e], 6).alias(e) for e in matching.EDGES]
    return found.select((F.col("key") % 5).alias("camera"), F.floor(F.col("key") / 5).alias("run"), "slot_id", "frames_seen", "frames", F.round("confidence", 6).alias("confidence"), *edges)


@_R.add(
    "class_prf",
    """
WITH c AS (SELECT r_regionkey AS k, r_name FROM region),
p AS (SELECT l_returnflag AS predicted, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS truth FROM lineitem),
n AS (SELECT v.label, count(*) FILTER (WHERE predicted = v.label AND truth = v.label) AS tp, count(*) FILTER (WHERE predicted = v.label AND truth <> v.label) AS fp,
             count(*) FILTER (WHERE predicted <> v.label AND truth = v.label) AS fn FROM p CROSS JOIN (VALUES ('A'), ('N'), ('R')) v(label) GROUP BY v.label)
SELECT label, tp, fp, fn, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall FROM n
""",
)
def class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false positives and negatives of each class; each row counts for its two classes only."""
    truth = F.when(F.col("l_quantity") < 20, "A").when(F.col("l_quantity") < 35, "N").otherwise("R")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("predicted"), truth.alias("truth"))
    counted = rows.groupBy("predicted", "truth").count()
    entry = lambda label, tp, fp, fn: F.struct(F.col(label).alias("label"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    hit, miss = F.array(entry("truth", 1, 0, 0)), F.array(entry("predicted", 0, 1, 0), entry("truth", 0, 0, 1))
    spread = counted.select("count", F.inline(F.when(F.col("predicted") == F.col("truth"), hit).otherwise(miss)))
    total = lambda c: F.sum(F.col(c) * F.col("count")).alias(c)
    out = spread.groupBy("label").agg(total("tp"), total("fp"), total("fn"))
    share = lambda other: F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col(other)), F.lit(0.0)), 6)
    return out.select("label", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))


@_R.add(
    "facility_counts",
    LINKS
    + """
, v AS (SELECT b.frame, b.vehicle_id, EXISTS (SELECT 1 FROM links k WHERE k.frame = b.frame AND k.vehicle_id = b.vehicle_id AND occupies) AS mapped, (b.x1 + b.x2) / 2 AS px, b.y2 - 0.5 AS py FROM b)
SELECT frame, count(*) FILTER (WHERE mapped) AS in_mapped_space, count(*) FILTER (WHERE NOT mapped AND px <= 25 AND py <= 20) AS in_parking_area,
       count(*) FILTER (WHERE NOT mapped AND NOT (px <= 25 AND py <= 20)) AS outside_parking_area, CAST(0 AS BIGINT) AS area_unknown,
       count(*) FILTER (WHERE mapped OR (px <= 25 AND py <= 20)) AS facility_vehicles FROM v GROUP BY frame
""",
)
def facility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame's vehicles stand; those outside the area do not count for the facility."""
    vehicles = _vehicles(spark, sf_dir)
    taken = matching.link_boxes(_slots(spark, sf_dir), vehicles, "frame").where("occupies").select("frame", "vehicle_id").distinct()
    marked = vehicles.join(taken.withColumn("mapped", F.lit(True)), ["frame", "vehicle_id"], "left")
    ground = polygons.point((F.col("box.x1") + F.col("box.x2")) / 2, F.col("box.y2") - 0.5)
    area = boxes.box(F.lit(0), F.lit(0), F.lit(25), F.lit(20))
    inside = boxes.contains(area, ground.x, ground.y)
    placement = F.when(F.col("mapped"), "in_mapped_space").when(inside, "in_parking_area").otherwise("outside_parking_area")
    names = ("in_mapped_space", "in_parking_area", "outside_parking_area", "area_unknown")
    placed = marked.select("frame", placement.alias("placement"))
    return placed.groupBy("frame").agg(*(F.count_if(F.col("placement") == n).alias(n) for n in names), F.count_if(F.col("placement") != "outside_parking_area").alias("facility_vehicles"))


@_R.add(
    "placement_summary",
    ITEMS + "SELECT label, count(*) FILTER (WHERE x2 <= 20) AS near, count(*) FILTER (WHERE x2 > 20 AND x2 <= 30) AS middle, count(*) FILTER (WHERE x2 > 30) AS far, count(*) FILTER (WHERE x2 IS NULL) AS unknown FROM items GROUP BY label",
)
def placement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all four placements, those without a vehicle too."""
    x = F.col("box.x2")
    kinds = {"near": x <= 20, "middle": (x > 20) & (x <= 30), "far": x > 30, "unknown": x.isNull()}
    return items(spark, sf_dir).groupBy("label").agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


@_R.add(
    "taxonomy_fold",
    """
SELECT CASE WHEN p_type = 'ECONOMY' THEN 'CAR' WHEN p_type = 'SMALL' THEN 'TWO_WHEELER' WHEN p_type = 'LARGE' THEN 'TRUCK' END AS kind, count(*) AS n FROM part GROUP BY 1
""",
)
def taxonomy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector labels folded into product classes; null for anything else."""
    label = F.when(F.col("p_type") == "ECONOMY", " Sedan ").when(F.col("p_type") == "SMALL", "moped").when(F.col("p_type") == "LARGE", "LORRY").otherwise("bus")
    return table(spark, sf_dir, "part").groupBy(vehicle_class(label).alias("kind")).agg(F.count("*").alias("n"))


_QUADS = """
WITH q AS (SELECT p_partkey, p_partkey % 50 / 100.0 AS x, p_size / 100.0 AS y, 0.1 + p_partkey % 7 / 50.0 AS w, p_partkey % 11 / 100.0 AS h FROM part)
"""


def _quads(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Parallelograms; spread deals their few bytes over all cores before the shapes are worked out."""
    k = F.col("p_partkey")
    x, y, w, h = k % 50 / 100.0, F.col("p_size") / 100.0, F.lit(0.1) + k % 7 / 50.0, k % 11 / 100.0
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    parts = parts.repartition(2 * spark.sparkContext.defaultParallelism) if spread else parts
    rows = parts.select("p_partkey", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    skew = F.array(F.array(F.col("x"), F.col("y")), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h") * 2), F.array(F.col("x"), F.col("y") + F.col("h")))
    return rows.withColumn("pairs", skew).withColumn("quad", polygons.from_pairs(F.col("pairs")))


@_R.add("polygon_area", _QUADS + "SELECT p_partkey, round(w * h, 9) AS area FROM q")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace areas of parallelograms."""
    return _quads(spark, sf_dir).select("p_partkey", F.round(polygons.area(F.col("quad")), 9).alias("area"))


@_R.add(
    "polygon_validity_reason",
    _QUADS + "SELECT p_partkey, CASE WHEN x + w > 1 OR y + h * 2 > 1 THEN 'coordinate_out_of_bounds' WHEN w * h < 1e-5 THEN 'area_too_small' END AS reason FROM q",
)
def polygon_validity_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a polygon is no sound geometry."""
    return _quads(spark, sf_dir).select("p_partkey", polygons.validity(F.col("pairs")).alias("reason"))


@_R.add(
    "canonical_order",
    _QUADS + "SELECT p_partkey, round(x, 6) AS first_x, round(y, 6) AS first_y, round(w * h, 9) AS area FROM q WHERE h > 0",
)
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the canonical order begins; it keeps the area."""
    ordered = polygons.canonical(F.reverse(F.col("quad")))
    rows = _quads(spark, sf_dir).where("h > 0").withColumn("o", ordered)
    return rows.select("p_partkey", F.round(F.col("o")[0].x, 6).alias("first_x"), F.round(F.col("o")[0].y, 6).alias("first_y"), F.round(polygons.area(F.col("o")), 9).alias("area"))


@_R.add("corner_error", _QUADS + "SELECT p_partkey, round(0.01 / sqrt(w * h), 6) AS error FROM q WHERE h > 0")
def corner_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner distance to the same quad moved by 0.01, whatever corner comes first."""
    moved = F.transform(F.col("quad"), lambda p: polygons.point(p.x + 0.01, p.y))
    error = polygons.corner_error(polygons.rotate(moved, 2), F.col("quad"))
    return _quads(spark, sf_dir).where("h > 0").select("p_partkey", F.round(error, 6).alias("error"))


@_R.add("median_bay_side", _QUADS + "SELECT round(quantile_cont(least(sqrt(w * w + h * h), h), 0.5), 6) AS side FROM q")
def median_bay_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the quads' shorter sides."""
    sides = _quads(spark, sf_dir, spread=True).select(polygons.shorter_side(F.col("quad")).alias("side"))
    return metrics.medians(sides, [], "side").select(F.round("median", 6).alias("side"))


@_R.add(
    "grid_cell_collisions",
    ITEMS
    + """
, c AS (SELECT frame, box_id, CAST(floor((x1 + x2) / 2 / 8) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2 / 8) AS BIGINT) AS cy FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, cx, cy ORDER BY box_id) AS n FROM c)
SELECT frame, count(*) FILTER (WHERE n = 1) AS cells, count(*) FILTER (WHERE n > 1) AS collisions FROM r GROUP BY frame
""",
)
def grid_cell_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by the cell of their centre: the first one takes it, the rest collide."""
    b = F.col("box")
    cells = items(spark, sf_dir).groupBy("frame", F.floor((b.x1 + b.x2) / 2 / 8).alias("cx"), F.floor((b.y1 + b.y2) / 2 / 8).alias("cy")).agg(F.count("*").alias("n"))
    return cells.groupBy("frame").agg(F.count("*").alias("cells"), F.sum(F.col("n") - 1).alias("collisions"))
