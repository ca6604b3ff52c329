"""Queries that judge detectors and models: matches, adjudication, thresholds, gates.

A frame's dataset is its number modulo 4; a box is occupied if its score is at least OCCUPIED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bayline.functions.numbers import ratio_floor_one
from bayline.operators import matching, metrics, selection
from bayline.plans.observations import OBS, observations
from bayline.plans.registry import Registry
from bayline.plans.scenes import ITEMS, LINKS, items, matched, matched_sql

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

OCCUPIED, PREDICTED = 0.05, 0.04
_AT_HALF = matched_sql(0.5)


def _dataset() -> Column:
    return F.col("frame") % 4


def _match_counts() -> list[Column]:
    hit = F.col("predicted_id").isNotNull() & F.col("truth_id").isNotNull()
    return [
        F.count_if(hit).alias("tp"), F.count_if(F.col("truth_id").isNull()).alias("fp"), F.count_if(F.col("predicted_id").isNull()).alias("fn"),
        F.count_if(F.col("overlap") >= 0.75).alias("tp_75"),
    ]


def _precision_recall() -> tuple[Column, Column]:
    return ratio_floor_one(F.col("tp"), F.col("tp") + F.col("fp")), ratio_floor_one(F.col("tp"), F.col("tp") + F.col("fn"))


_TALLY = """count(*) FILTER (WHERE predicted_id IS NOT NULL AND truth_id IS NOT NULL) AS tp, count(*) FILTER (WHERE truth_id IS NULL) AS fp,
       count(*) FILTER (WHERE predicted_id IS NULL) AS fn, count(*) FILTER (WHERE overlap >= 0.75) AS tp_75"""
_P, _REC = "tp * 1.0 / greatest(tp + fp, 1)", "tp * 1.0 / greatest(tp + fn, 1)"


@_R.add(
    "match_metrics",
    _AT_HALF
    + f"""
, f AS (SELECT frame, abs(count(predicted_id) - count(truth_id)) AS off FROM m GROUP BY frame),
t AS (SELECT {_TALLY}, coalesce(avg(corner_error), 1.0) AS corner FROM m)
SELECT tp, fp, fn, round({_P}, 6) AS "precision", round({_REC}, 6) AS recall, round(2 * ({_P}) * ({_REC}) / greatest({_P} + {_REC}, 1e-9), 6) AS f1,
       round(tp_75 * 1.0 / greatest(tp + fn, 1), 6) AS recall_75, round(corner, 6) AS corner_error, (SELECT round(avg(off), 3) FROM f) AS count_error,
       round(fn * 1.0 / greatest(tp + fn, 1), 6) AS missed_rate, (SELECT count(*) FROM f) AS frames FROM t
""",
)
def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1, recall at 0.75, corner error, count error and missed rate of a matching at one half."""
    off = F.abs(F.count("predicted_id") - F.count("truth_id"))
    corners = [F.sum("corner_error").alias("corners"), F.count("corner_error").alias("pairs")]
    frames = matched(spark, sf_dir, 0.5, tie="last").groupBy("frame").agg(*_match_counts(), *corners, off.alias("off"))
    total = frames.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tp_75", "corners", "pairs")), F.round(F.avg("off"), 3).alias("count_error"), F.count("*").alias("frames"))
    p, r = _precision_recall()
    share = lambda c: F.round(ratio_floor_one(F.col(c), F.col("tp") + F.col("fn")), 6)
    return total.select(
        "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 6).alias("f1"),
        share("tp_75").alias("recall_75"), F.round(F.coalesce(F.try_divide("corners", "pairs"), F.lit(1.0)), 6).alias("corner_error"), "count_error",
        share("fn").alias("missed_rate"), "frames",
    )


@_R.add("match_metrics_by_dataset", _AT_HALF + f", t AS (SELECT frame % 4 AS dataset, {_TALLY} FROM m GROUP BY 1) SELECT dataset, tp, fp, fn, round({_P}, 6) AS \"precision\", round({_REC}, 6) AS recall FROM t")
def match_metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the matching, of each dataset."""
    p, r = _precision_recall()
    counts = matched(spark, sf_dir, 0.5, tie="last").groupBy(_dataset().alias("dataset")).agg(*_match_counts())
    return counts.select("dataset", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@_R.add(
    "worst_layouts",
    _AT_HALF
    + """
, f AS (SELECT frame, count(truth_id) AS truth_slots, count(predicted_id) AS detected_slots, count(*) FILTER (WHERE predicted_id IS NOT NULL AND truth_id IS NOT NULL) AS matched FROM m GROUP BY frame)
SELECT frame, truth_slots, detected_slots, matched, round(matched * 1.0 / greatest(truth_slots, 1), 6) AS recall, abs(detected_slots - truth_slots) AS count_error FROM f
ORDER BY recall, count_error DESC, frame LIMIT 10
""",
)
def worst_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten frames of least recall, then of greatest count error."""
    hit = F.col("predicted_id").isNotNull() & F.col("truth_id").isNotNull()
    frames = matched(spark, sf_dir, 0.5, tie="last").groupBy("frame").agg(F.count("truth_id").alias("truth_slots"), F.count("predicted_id").alias("detected_slots"), F.count_if(hit).alias("matched"))
    recall = F.round(ratio_floor_one(F.col("matched"), F.col("truth_slots")), 6)
    rows = frames.withColumns({"recall": recall, "count_error": F.abs(F.col("detected_slots") - F.col("truth_slots"))})
    return rows.orderBy("recall", F.desc("count_error"), "frame").limit(10)


@_R.add(
    "matched_occupancy",
    _AT_HALF
    + f"""
, s AS (SELECT predicted_id IS NOT NULL AND truth_id IS NOT NULL AS hit, truth_id IS NOT NULL AS slot, predicted_score >= {PREDICTED} AS p, truth_score >= {OCCUPIED} AS t FROM m),
o AS (SELECT count(*) FILTER (WHERE hit) AS matched_slots, count(*) FILTER (WHERE slot) AS truth_slots, count(*) FILTER (WHERE hit AND p AND t) AS tp, count(*) FILTER (WHERE hit AND NOT p AND NOT t) AS tn,
             count(*) FILTER (WHERE hit AND p AND NOT t) AS fp, count(*) FILTER (WHERE hit AND NOT p AND t) AS fn FROM s)
SELECT matched_slots, truth_slots, round(matched_slots * 1.0 / greatest(truth_slots, 1), 6) AS coverage, tp, tn, fp, fn, round(coalesce((tp + tn) * 1.0 / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
       round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall FROM o
""",
)
def matched_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy metrics over the slots that detected geometry found, and how many of all slots those are."""
    pairs = matched(spark, sf_dir, 0.5, tie="last")
    hit = F.col("predicted_id").isNotNull() & F.col("truth_id").isNotNull()
    predicted, truth = hit & (F.col("predicted_score") >= PREDICTED), F.col("truth_score") >= OCCUPIED
    both = pairs.withColumns({"p": F.when(hit, predicted), "t": F.when(hit, truth)})
    counts = both.agg(F.count_if(hit).alias("matched_slots"), F.count("truth_id").alias("truth_slots"), *metrics.confusion(F.col("p"), F.col("t")))
    coverage = F.round(ratio_floor_one(F.col("matched_slots"), F.col("truth_slots")), 6)
    return metrics.zero_metrics(counts).withColumn("coverage", coverage).select("matched_slots", "truth_slots", "coverage", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall")


_FAMILY = "coalesce(CAST(family AS VARCHAR), 'ALL') AS family"


@_R.add(
    "detector_adjudication",
    LINKS
    + f"""
, s AS (SELECT i.frame, i.box_id, score >= {OCCUPIED} AS occupied, EXISTS (SELECT 1 FROM links k WHERE k.frame = i.frame AND k.slot_id = i.box_id AND occupies) AS found FROM items i WHERE is_slot),
w AS (SELECT k.frame, k.vehicle_id, bool_or(s.occupied) AS real FROM links k JOIN s ON s.frame = k.frame AND s.box_id = k.slot_id WHERE occupies GROUP BY ALL),
u AS (
  SELECT frame, occupied AS b, found AS f, NULL AS v, NULL AS r, NULL AS label FROM s
  UNION ALL SELECT i.frame, NULL, NULL, TRUE, w.real, i.label FROM items i LEFT JOIN w ON w.frame = i.frame AND w.vehicle_id = i.box_id WHERE NOT is_slot),
c AS (SELECT frame % 4 AS family, count(*) FILTER (WHERE b) AS occupied_bays, count(*) FILTER (WHERE NOT b) AS vacant_bays, count(*) FILTER (WHERE b AND f) AS occupied_found, count(*) FILTER (WHERE NOT b AND f) AS vacant_found,
             count(v) AS vehicles, count(*) FILTER (WHERE v AND r IS NULL) AS unmapped, count(*) FILTER (WHERE r) AS real, count(*) FILTER (WHERE NOT r) AS unreal, count(DISTINCT frame) AS frames,
             count(*) FILTER (WHERE label = 'A') AS kind_a, count(*) FILTER (WHERE label = 'N') AS kind_n, count(*) FILTER (WHERE label = 'R') AS kind_r FROM u GROUP BY ROLLUP (frame % 4))
SELECT {_FAMILY}, occupied_bays, vacant_bays, vehicles, unmapped, round(occupied_found * 1.0 / nullif(occupied_bays, 0), 4) AS occupied_recall, round(vacant_found * 1.0 / nullif(vacant_bays, 0), 4) AS vacant_false_rate,
       real + unreal AS adjudicated, round(real * 1.0 / nullif(real + unreal, 0), 4) AS "precision", round(unreal * 1.0 / nullif(frames, 0), 4) AS false_per_frame, kind_a, kind_n, kind_r FROM c
""",
)
def detector_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often bays show a vehicle, by their state, and which detections a labelled bay confirms, of each family and ALL.

    A vehicle that stands on an occupied bay is real, one that only stands on vacant bays is not;
    those outside every bay are not judged.
    """
    rows = items(spark, sf_dir)
    slots = rows.where("is_slot").select("frame", F.col("box_id").alias("slot_id"), "box", (F.col("score") >= OCCUPIED).alias("occupied"))
    vehicles = rows.where("not is_slot").select("frame", F.col("box_id").alias("vehicle_id"), "box", "label")
    links = matching.link_boxes(slots, vehicles, "frame").where("occupies").select("frame", "slot_id", "vehicle_id")
    judged = links.join(slots.select("frame", "slot_id", "occupied"), ["frame", "slot_id"])
    bays = slots.join(links.select("frame", "slot_id").distinct().withColumn("found", F.lit(True)), ["frame", "slot_id"], "left").select("frame", "occupied", "found")
    owners = judged.groupBy("frame", "vehicle_id").agg(F.bool_or("occupied").alias("real"))
    seen = vehicles.join(owners, ["frame", "vehicle_id"], "left").select("frame", "label", "real", F.lit(True).alias("vehicle"))
    every = bays.unionByName(seen, allowMissingColumns=True).withColumn("family", _dataset())
    c = F.col
    counts = every.rollup("family").agg(
        F.count_if("occupied").alias("occupied_bays"), F.count_if(~c("occupied")).alias("vacant_bays"),
        F.count_if(c("occupied") & c("found")).alias("occupied_found"), F.count_if(~c("occupied") & c("found")).alias("vacant_found"),
        F.count("vehicle").alias("vehicles"), F.count_if(c("vehicle") & c("real").isNull()).alias("unmapped"),
        F.count_if("real").alias("confirmed"), F.count_if(~c("real")).alias("refuted"), F.count_distinct("frame").alias("frames"),
        *(F.count_if(c("label") == k.upper()).alias(f"kind_{k}") for k in "anr"),
    )
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    judged_n = c("confirmed") + c("refuted")
    return counts.select(
        F.coalesce(c("family").cast("string"), F.lit("ALL")).alias("family"), "occupied_bays", "vacant_bays", "vehicles", "unmapped",
        share("occupied_found", "occupied_bays").alias("occupied_recall"), share("vacant_found", "vacant_bays").alias("vacant_false_rate"), judged_n.alias("adjudicated"),
        share("confirmed", judged_n).alias("precision"), share("refuted", "frames").alias("false_per_frame"), "kind_a", "kind_n", "kind_r",
    )


_STEPS = 13


@_R.add(
    "detector_threshold_grid",
    _AT_HALF
    + f"""
, g AS (SELECT i, round(0.01 + 0.005 * i, 9) AS threshold FROM range({_STEPS}) r(i)),
e AS (SELECT i, threshold, frame, count(*) FILTER (WHERE predicted_id IS NOT NULL AND truth_id IS NOT NULL AND round(predicted_score, 9) >= threshold) AS tp,
             count(*) FILTER (WHERE truth_id IS NULL AND round(predicted_score, 9) >= threshold) AS fp, count(truth_id) AS slots FROM m CROSS JOIN g GROUP BY ALL),
d AS (SELECT i, frame % 4 AS dataset, round(sum(tp) * 1.0 / greatest(sum(slots), 1), 6) AS recall FROM e GROUP BY 1, 2),
t AS (SELECT i, threshold, sum(tp) * 1.0 / greatest(sum(tp + fp), 1) AS p, sum(tp) * 1.0 / greatest(sum(slots), 1) AS r, round(avg(abs(tp + fp - slots)), 3) AS off FROM e GROUP BY 1, 2),
o AS (SELECT t.*, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1, (SELECT min(recall) FROM d WHERE d.i = t.i) AS worst FROM t)
SELECT arg_max(threshold, (worst, f1, -off, -i)) AS threshold, max(worst) AS worst_recall FROM o
""",
)
def detector_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector threshold of the best worst dataset recall, then F1, then count error.

    Predictions are matched once, at the lowest threshold: they take their truths by falling
    score, so a higher threshold keeps a prefix of the same matching. Frames are counted by the
    number of thresholds their predictions pass before the grid multiplies them.
    """
    passed = F.least(F.floor(F.round((F.col("predicted_score") - 0.01) / 0.005, 6)) + 1, F.lit(_STEPS))
    hit = F.col("predicted_id").isNotNull() & F.col("truth_id").isNotNull()
    pairs = matched(spark, sf_dir, 0.5, tie="last").withColumn("passed", passed)
    counted = pairs.groupBy("frame").agg(
        F.collect_list(F.when(hit, F.col("passed"))).alias("hits"), F.collect_list(F.when(F.col("truth_id").isNull(), F.col("passed"))).alias("misses"), F.count("truth_id").alias("slots")
    )
    grid = counted.select("frame", "slots", "hits", "misses", F.explode(F.sequence(F.lit(0), F.lit(_STEPS - 1))).alias("i"))
    beyond = lambda c: F.size(F.filter(c, lambda x: x > F.col("i")))
    frames = grid.select("i", _dataset().alias("dataset"), "slots", beyond("hits").alias("tp"), beyond("misses").alias("fp"))
    off = F.abs(F.col("tp") + F.col("fp") - F.col("slots"))
    by_dataset = frames.groupBy("i", "dataset").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "slots")), F.sum(off).alias("off"), F.count("*").alias("frames"))
    recall = F.round(ratio_floor_one(F.col("tp"), F.col("slots")), 6)
    points = by_dataset.withColumn("recall", recall).groupBy("i").agg(F.min("recall").alias("worst"), *(F.sum(c).alias(c) for c in ("tp", "fp", "slots", "off", "frames")))
    p, r = ratio_floor_one(F.col("tp"), F.col("tp") + F.col("fp")), ratio_floor_one(F.col("tp"), F.col("slots"))
    objective = [F.col("worst"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 6), -F.round(F.col("off") / F.col("frames"), 3), -F.col("i")]
    best = selection.best(points, objective, ["i", "worst"])
    return best.select(F.round(0.01 + 0.005 * F.col("i"), 9).alias("threshold"), F.col("worst").alias("worst_recall"))


@_R.add(
    "layout_confidence_grid",
    _AT_HALF
    + """
, f AS (SELECT frame, coalesce(max(predicted_score), 0) AS confidence, count(*) FILTER (WHERE predicted_id IS NOT NULL AND truth_id IS NOT NULL) AS tp, count(*) FILTER (WHERE truth_id IS NULL) AS fp, count(truth_id) AS slots FROM m GROUP BY frame),
g AS (SELECT i, round(0.05 + 0.005 * i, 9) AS threshold FROM range(12) r(i)),
d AS (SELECT i, threshold, frame % 4 AS dataset, sum(CASE WHEN round(confidence, 9) >= threshold THEN tp ELSE 0 END) AS tp, sum(CASE WHEN round(confidence, 9) >= threshold THEN fp ELSE 0 END) AS fp, sum(slots) AS slots FROM f CROSS JOIN g GROUP BY ALL),
o AS (SELECT i, threshold, min(round(tp * 1.0 / greatest(slots, 1), 6)) AS recall, min(round(tp * 1.0 / greatest(tp + fp, 1), 6)) AS prec FROM d GROUP BY ALL)
SELECT arg_max(threshold, (recall, prec, -i)) AS threshold, arg_max(recall, (recall, prec, -i)) AS worst_recall, arg_max(prec, (recall, prec, -i)) AS worst_precision FROM o
""",
)
def layout_confidence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout confidence below which frames report nothing, by worst dataset recall, then precision.

    A frame's confidence is its best score. Frames are counted by the number of thresholds they
    pass; the grid multiplies those counts.
    """
    frames = matched(spark, sf_dir, 0.5, tie="last").groupBy("frame").agg(*_match_counts(), F.coalesce(F.max("predicted_score"), F.lit(0.0)).alias("confidence"))
    passed = F.least(F.greatest(F.floor(F.round((F.col("confidence") - 0.05) / 0.005, 6)) + 1, F.lit(0)), F.lit(12))
    counted = frames.groupBy(_dataset().alias("dataset"), passed.alias("passed")).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    grid = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    kept = lambda c: F.sum(F.when(F.col("passed") > F.col("i"), F.col(c)).otherwise(0))
    points = grid.groupBy("i", "dataset").agg(kept("tp").alias("tp"), kept("fp").alias("fp"), F.sum(F.col("tp") + F.col("fn")).alias("slots"))
    worst = points.groupBy("i").agg(
        F.min(F.round(ratio_floor_one(F.col("tp"), F.col("slots")), 6)).alias("recall"), F.min(F.round(ratio_floor_one(F.col("tp"), F.col("tp") + F.col("fp")), 6)).alias("prec")
    )
    best = selection.best(worst, [F.col("recall"), F.col("prec"), -F.col("i")], ["i", "recall", "prec"])
    return best.select(F.round(0.05 + 0.005 * F.col("i"), 9).alias("threshold"), F.col("recall").alias("worst_recall"), F.col("prec").alias("worst_precision"))


#: Candidate models: the threshold of each one's verdict and its latency.
MODELS = {"small": (0.35, 0.4), "medium": (0.5, 0.7), "large": (0.65, 1.9)}


@_R.add(
    "model_choice",
    OBS
    + f"""
, m(model, threshold, latency) AS (VALUES {", ".join(f"('{k}', {t}, {s})" for k, (t, s) in MODELS.items())}),
v AS (SELECT model, latency, camera, slot, p >= threshold AS y, truth FROM obs CROSS JOIN m),
b AS (SELECT model, latency, camera, slot, GROUPING_ID(camera, slot) AS level, round((coalesce(count(*) FILTER (WHERE y AND truth) * 1.0 / nullif(count(*) FILTER (WHERE truth), 0), 0)
      + coalesce(count(*) FILTER (WHERE NOT y AND NOT truth) * 1.0 / nullif(count(*) FILTER (WHERE NOT truth), 0), 0)) / 2, 6) AS ba FROM v GROUP BY GROUPING SETS ((model, latency), (model, latency, camera), (model, latency, slot))),
o AS (SELECT model, latency, min(ba) FILTER (WHERE level = 2) AS worst_group, min(ba) FILTER (WHERE level = 1) AS worst_dataset, min(ba) FILTER (WHERE level = 3) AS overall FROM b GROUP BY 1, 2)
SELECT arg_max(model, (worst_group, worst_dataset, overall, -latency)) AS model FROM o
""",
)
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the best worst group (slot), then worst dataset (camera), then overall accuracy, then latency."""
    verdicts = F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.lit(s).alias("latency"), (F.col("p") >= t).alias("y")) for k, (t, s) in MODELS.items())))
    rows = observations(spark, sf_dir).select("camera", "slot", "truth", verdicts.alias("v")).select("camera", "slot", "truth", "v.*")
    levels = rows.groupingSets([["model", "latency"], ["model", "latency", "camera"], ["model", "latency", "slot"]], "model", "latency", "camera", "slot")
    counts = levels.agg(*metrics.confusion(F.col("y"), F.col("truth")), F.grouping("camera").alias("no_camera"), F.grouping("slot").alias("no_slot"))
    ba = counts.withColumn("ba", F.round(selection.balanced_accuracy(), 6))
    least = lambda c: F.min(F.when(c, F.col("ba")))
    points = ba.groupBy("model", "latency").agg(
        least(F.col("no_slot") == 0).alias("worst_group"), least(F.col("no_camera") == 0).alias("worst_dataset"), least((F.col("no_camera") == 1) & (F.col("no_slot") == 1)).alias("overall")
    )
    return selection.best(points, [F.col("worst_group"), F.col("worst_dataset"), F.col("overall"), -F.col("latency")], ["model"])


@_R.add(
    "majority_baseline",
    OBS
    + """
SELECT camera, count(*) AS samples, count(DISTINCT slot) AS sources, count(DISTINCT CAST(ts AS DATE)) AS groups, count(*) FILTER (WHERE NOT truth) AS vacant, count(*) FILTER (WHERE truth) AS occupied,
       round(greatest(count(*) FILTER (WHERE truth), count(*) FILTER (WHERE NOT truth)) * 1.0 / count(*), 6) AS majority_accuracy FROM obs GROUP BY camera
""",
)
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What always guessing the commoner state scores, and how many samples, sources and groups there are."""
    yes, no = F.count_if("truth"), F.count_if(~F.col("truth"))
    return observations(spark, sf_dir).groupBy("camera").agg(
        F.count("*").alias("samples"), F.count_distinct("slot").alias("sources"), F.count_distinct(F.to_date("ts")).alias("groups"),
        no.alias("vacant"), yes.alias("occupied"), F.round(F.greatest(yes, no) / F.count("*"), 6).alias("majority_accuracy"),
    )


_SIGNALS = {"raw": "p", "fused": "0.5 * p + 0.25"}
_LOWER, _UPPER = 0.4, 0.6


@_R.add(
    "fusion_comparison",
    OBS
    + f"""
, v AS ({" UNION ALL ".join(f"SELECT camera, '{k}' AS signal, {e} AS q, truth FROM obs" for k, e in _SIGNALS.items())}),
c AS (SELECT signal, camera, count(*) AS bays, avg(CASE WHEN truth THEN CAST(q >= {_UPPER} AS INTEGER) END) AS hit, avg(CASE WHEN NOT truth THEN CAST(q < {_UPPER} AS INTEGER) END) AS clear,
             avg(CAST(q <= {_LOWER} OR q >= {_UPPER} AS INTEGER)) AS decided, avg(CASE WHEN q <= {_LOWER} OR q >= {_UPPER} THEN CAST((q >= {_UPPER}) <> truth AS INTEGER) END) AS wrong FROM v GROUP BY GROUPING SETS ((signal), (signal, camera)))
SELECT signal, coalesce(camera, 'ALL') AS camera, bays, round((coalesce(hit, 0) + coalesce(clear, 0)) / 2, 6) AS balanced_accuracy, round(coalesce(1 - hit, 0), 6) AS false_vacant, round(coalesce(1 - clear, 0), 6) AS false_occupied,
       round(decided, 6) AS decided_share, round(wrong, 6) AS error_where_decided FROM c WHERE bays >= 50
""",
)
def fusion_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals under one band of indecision, overall and of each camera with fifty readings or more."""
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.expr(e).alias("q")) for k, e in _SIGNALS.items())))
    rows = observations(spark, sf_dir).select("camera", "truth", both.alias("s")).select("camera", "truth", "s.*")
    yes = F.col("q") >= _UPPER
    decided = (F.col("q") <= _LOWER) | yes
    mean = lambda c, where=F.lit(True): F.avg(F.when(where, c.cast("double")))
    counts = rows.groupingSets([["signal"], ["signal", "camera"]], "signal", "camera").agg(
        F.count("*").alias("bays"), mean(yes, F.col("truth")).alias("hit"), mean(~yes, ~F.col("truth")).alias("clear"),
        mean(decided).alias("decided"), mean(yes != F.col("truth"), decided).alias("wrong"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.where("bays >= 50").select(
        "signal", F.coalesce("camera", F.lit("ALL")).alias("camera"), "bays", F.round((zero(F.col("hit")) + zero(F.col("clear"))) / 2, 6).alias("balanced_accuracy"),
        F.round(zero(1 - F.col("hit")), 6).alias("false_vacant"), F.round(zero(1 - F.col("clear")), 6).alias("false_occupied"),
        F.round("decided", 6).alias("decided_share"), F.round("wrong", 6).alias("error_where_decided"),
    )


#: A deployment needs these: least balanced accuracy, least of the worst camera, most false vacancies.
GATE = (0.45, 0.4, 0.6)


@_R.add(
    "deployment_gate",
    OBS
    + f"""
, c AS (SELECT camera, count(*) FILTER (WHERE p >= 0.5 AND truth) AS tp, count(*) FILTER (WHERE p < 0.5 AND NOT truth) AS tn, count(*) FILTER (WHERE truth) AS yes, count(*) FILTER (WHERE NOT truth) AS no FROM obs GROUP BY ROLLUP (camera)),
b AS (SELECT camera, round((coalesce(tp * 1.0 / nullif(yes, 0), 0) + coalesce(tn * 1.0 / nullif(no, 0), 0)) / 2, 6) AS ba, round((yes - tp) * 1.0 / greatest(yes, 1), 6) AS missed FROM c),
g AS (SELECT max(ba) FILTER (WHERE camera IS NULL) AS balanced_accuracy, min(ba) FILTER (WHERE camera IS NOT NULL) AS worst_camera, max(missed) FILTER (WHERE camera IS NULL) AS false_vacant_rate FROM b)
SELECT *, balanced_accuracy >= {GATE[0]} AND worst_camera >= {GATE[1]} AND false_vacant_rate <= {GATE[2]} AS passed FROM g
""",
)
def deployment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a model's metrics let it be deployed."""
    counts = observations(spark, sf_dir).rollup("camera").agg(*metrics.confusion(F.col("p") >= 0.5, F.col("truth")), F.grouping("camera").alias("all"))
    missed = F.round(F.col("fn") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), 6)
    rows = counts.withColumns({"ba": F.round(selection.balanced_accuracy(), 6), "missed": missed})
    out = rows.agg(
        F.max(F.when(F.col("all") == 1, F.col("ba"))).alias("balanced_accuracy"), F.min(F.when(F.col("all") == 0, F.col("ba"))).alias("worst_camera"),
        F.max(F.when(F.col("all") == 1, F.col("missed"))).alias("false_vacant_rate"),
    )
    passed = (F.col("balanced_accuracy") >= GATE[0]) & (F.col("worst_camera") >= GATE[1]) & (F.col("false_vacant_rate") <= GATE[2])
    return out.withColumn("passed", passed)


@_R.add(
    "count_agreement",
    ITEMS
    + f"""
SELECT frame, count(*) FILTER (WHERE score >= {PREDICTED}) AS occupied, count(*) FILTER (WHERE score >= {OCCUPIED}) AS truth, count(*) FILTER (WHERE (score >= {PREDICTED}) <> (score >= {OCCUPIED})) AS disagreeing,
       abs(count(*) FILTER (WHERE score >= {PREDICTED}) - count(*) FILTER (WHERE score >= {OCCUPIED})) <= count(*) FILTER (WHERE (score >= {PREDICTED}) <> (score >= {OCCUPIED})) AS consistent FROM items WHERE is_slot GROUP BY frame
""",
)
def count_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's counts of predicted and true occupied slots; they may differ by no more than slots disagree."""
    said, true = F.col("score") >= PREDICTED, F.col("score") >= OCCUPIED
    counts = items(spark, sf_dir).where("is_slot").groupBy("frame").agg(F.count_if(said).alias("occupied"), F.count_if(true).alias("truth"), F.count_if(said != true).alias("disagreeing"))
    return counts.withColumn("consistent", F.abs(F.col("occupied") - F.col("truth")) <= F.col("disagreeing"))


@_R.add(
    "slot_count_ladder",
    ITEMS
    + """
SELECT frame, count(*) FILTER (WHERE is_slot) AS slots, CASE WHEN count(*) FILTER (WHERE is_slot) = 0 THEN 'not_detected' WHEN count(*) FILTER (WHERE is_slot) NOT BETWEEN 4 AND 250 THEN 'outside_domain'
       WHEN round(avg(score) FILTER (WHERE is_slot), 9) < 0.05 THEN 'uncertain' ELSE 'detected' END AS status FROM items GROUP BY frame
""",
)
def slot_count_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's status by how many slots it shows, and by their mean confidence, to nine digits: its last bits hang on the order of the sum."""
    slot = F.col("is_slot")
    rows = items(spark, sf_dir).groupBy("frame").agg(F.count_if(slot).alias("slots"), F.avg(F.when(slot, F.col("score"))).alias("mean"))
    status = F.when(F.col("slots") == 0, "not_detected").when(~F.col("slots").between(4, 250), "outside_domain").when(F.round("mean", 9) < 0.05, "uncertain").otherwise("detected")
    return rows.select("frame", "slots", status.alias("status"))


@_R.add(
    "canonical_slots",
    ITEMS + "SELECT frame % 50 AS layout, arg_min(n, frame) AS slots, min(frame) AS first_frame FROM (SELECT frame, count(*) AS n FROM items WHERE is_slot GROUP BY frame) GROUP BY 1",
)
def canonical_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of each layout's first frame in manifest order."""
    frames = items(spark, sf_dir).where("is_slot").groupBy("frame").agg(F.count("*").alias("n"))
    return frames.groupBy((F.col("frame") % 50).alias("layout")).agg(F.min_by("n", "frame").alias("slots"), F.min("frame").alias("first_frame"))


@_R.add(
    "sampled_frames",
    "SELECT camera, count(*) AS frames, round(max(frame) / 25.0, 3) AS seconds FROM (SELECT event_type AS camera, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS frame FROM events) WHERE frame % 5 = 0 GROUP BY camera",
)
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame of each slot's series, and the seconds into it of the last at 25 frames a second."""
    place = F.row_number().over(Window.partitionBy("camera", "slot").orderBy("ts", "id")) - 1
    frames = observations(spark, sf_dir).withColumn("frame", place).where("frame % 5 = 0")
    return frames.groupBy("camera").agg(F.count("*").alias("frames"), F.round(F.max("frame") / 25.0, 3).alias("seconds"))
