"""Queries over per-slot observations: events are readings of slots by camera."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bayline.functions.numbers import confidence, logit, sigmoid
from bayline.functions.verdicts import DEFAULT_WEIGHTS, FITTED_WEIGHTS, closed_band, contributions, fuse, open_band
from bayline.operators import metrics, selection, temporal
from bayline.operators.ranks import with_places
from bayline.plans.registry import Registry
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: slot, time, probability of being occupied, truth and camera."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("slot"),
        "ts",
        F.col("event_type").alias("camera"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("p"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("int") >= 50).alias("truth"),
    )


OBS = """
WITH obs AS (
  SELECT event_id AS id, user_id AS slot, ts, event_type AS camera, least(value / 100, 1.0) AS p,
         CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) >= 50 AS truth
  FROM events)
"""
_COUNTS = """count(*) FILTER (WHERE p >= 0.5 AND truth) AS tp, count(*) FILTER (WHERE NOT p >= 0.5 AND NOT truth) AS tn,
       count(*) FILTER (WHERE p >= 0.5 AND NOT truth) AS fp, count(*) FILTER (WHERE NOT p >= 0.5 AND truth) AS fn"""
_ROUNDED = """round(tp * 1.0 / nullif(tp + fp, 0), 6) AS "precision", round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall,
       round(tn * 1.0 / nullif(tn + fp, 0), 6) AS specificity, round((tp + tn) * 1.0 / nullif(tp + tn + fp + fn, 0), 6) AS accuracy"""
_NULLABLE = f"""
, c AS (SELECT camera, {_COUNTS} FROM obs GROUP BY {{group}}), r AS (SELECT *, {_ROUNDED} FROM c)
SELECT camera, tp, tn, fp, fn, accuracy, "precision", recall, specificity, round((recall + specificity) / 2, 6) AS balanced_accuracy,
       round(2 * "precision" * recall / nullif("precision" + recall, 0), 6) AS f1 FROM r
"""


def _counts(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(*metrics.confusion(F.col("p") >= 0.5, F.col("truth")))


@_R.add("confusion_overall", OBS + f"SELECT {_COUNTS} FROM obs")
def confusion_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counts over all readings."""
    return _counts(observations(spark, sf_dir))


@_R.add("confusion_by_dataset", OBS + _NULLABLE.format(group="ROLLUP(camera)"))
def confusion_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and nullable metrics of each camera and of all together."""
    counts = observations(spark, sf_dir).rollup("camera").agg(*metrics.confusion(F.col("p") >= 0.5, F.col("truth")))
    return metrics.nullable_metrics(counts)


@_R.add(
    "classification_metrics_zero",
    OBS
    + f"""
, c AS (SELECT slot, {_COUNTS} FROM obs GROUP BY slot),
r AS (SELECT *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS p, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS q, coalesce(tn * 1.0 / nullif(tn + fp, 0), 0) AS s FROM c)
SELECT slot, tp, tn, fp, fn, round(coalesce((tp + tn) * 1.0 / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(p, 6) AS "precision", round(q, 6) AS recall,
       round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1, round(s, 6) AS specificity, round((q + s) / 2, 6) AS balanced_accuracy FROM r
""",
)
def classification_metrics_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each slot, zero where a denominator is."""
    return metrics.zero_metrics(_counts(observations(spark, sf_dir), "slot"))


@_R.add(
    "brier_rates",
    OBS
    + """
SELECT camera, round(avg(power(p - CAST(truth AS INTEGER), 2)), 6) AS brier,
       round(count(*) FILTER (WHERE truth AND p < 0.5) * 1.0 / greatest(count(*) FILTER (WHERE truth), 1), 6) AS false_vacant_rate,
       round(count(*) FILTER (WHERE NOT truth AND p >= 0.5) * 1.0 / greatest(count(*) FILTER (WHERE NOT truth), 1), 6) AS false_occupied_rate, count(*) AS n
FROM obs GROUP BY camera
""",
)
def brier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and false rates of each camera."""
    return metrics.probability_metrics(observations(spark, sf_dir), ["camera"], "p", "truth")


@_R.add(
    "ece_10bins",
    OBS
    + """
, b AS (SELECT camera, least(CAST(floor(greatest(p, 1 - p) * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(greatest(p, 1 - p)) AS sure,
               avg(CAST((p >= 0.5) = truth AS INTEGER)) AS "right" FROM obs GROUP BY 1, 2)
SELECT camera, round(sum(n * abs(sure - "right")) / sum(n), 6) AS calibration_error, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY camera
""",
)
def ece_10bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error of each camera."""
    return metrics.calibration_error(observations(spark, sf_dir), ["camera"], "p", "truth")


@_R.add(
    "worst_groups",
    OBS
    + f"""
, c AS (SELECT slot, {_COUNTS} FROM obs GROUP BY slot),
r AS (SELECT slot, tp + tn + fp + fn AS n, round((coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) + coalesce(tn * 1.0 / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM c)
SELECT slot, n, balanced_accuracy FROM r ORDER BY balanced_accuracy, slot LIMIT 10
""",
)
def worst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten slots of the least balanced accuracy."""
    scored = metrics.zero_metrics(_counts(observations(spark, sf_dir), "slot"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return scored.select("slot", n.alias("n"), "balanced_accuracy").orderBy("balanced_accuracy", "slot").limit(10)


@_R.add(
    "error_summary",
    OBS
    + """
SELECT camera, count(*) FILTER (WHERE (p >= 0.5) <> truth) AS errors,
       count(*) FILTER (WHERE (p >= 0.5) <> truth AND greatest(p, 1 - p) >= 0.8) AS sure_and_wrong,
       count(*) FILTER (WHERE (p >= 0.5) <> truth AND abs(p - 0.5) <= 0.1) AS borderline_and_wrong, count(*) AS n
FROM obs GROUP BY camera
""",
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each camera by how sure they were."""
    p = F.col("p")
    return observations(spark, sf_dir).groupBy("camera").agg(*metrics.error_summary(p >= 0.5, F.col("truth"), confidence(p), p))


@_R.add(
    "recent_errors_25",
    OBS + "SELECT id, slot, camera, round(p, 6) AS p FROM obs WHERE (p >= 0.5) <> truth ORDER BY ts DESC, id DESC LIMIT 25",
)
def recent_errors_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 latest wrong readings."""
    wrong = observations(spark, sf_dir).where((F.col("p") >= 0.5) != F.col("truth"))
    return wrong.orderBy(F.desc("ts"), F.desc("id")).limit(25).select("id", "slot", "camera", F.round("p", 6).alias("p"))


@_R.add(
    "distinct_slots_repeats",
    OBS
    + """
SELECT camera, count(*) AS evaluated, count(DISTINCT slot) AS distinct_slots, count(*) - count(DISTINCT slot) AS repeated FROM obs GROUP BY camera
""",
)
def distinct_slots_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings against distinct slots of each camera."""
    slots = F.count_distinct("slot")
    return observations(spark, sf_dir).groupBy("camera").agg(F.count("*").alias("evaluated"), slots.alias("distinct_slots"), (F.count("*") - slots).alias("repeated"))


@_R.add(
    "grouping_sets_tally",
    OBS
    + """
SELECT camera, truth, count(*) AS n, round(avg(p), 6) AS mean_p FROM obs GROUP BY GROUPING SETS ((camera), (), (truth), (camera, truth))
""",
)
def grouping_sets_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by camera, by state, by both and overall."""
    sets = [[F.col("camera")], [], [F.col("truth")], [F.col("camera"), F.col("truth")]]
    grouped = observations(spark, sf_dir).groupingSets(sets, "camera", "truth")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@_R.add(
    "percentile_by_index",
    OBS
    + """
, o AS (SELECT slot, list_sort(list(p)) AS l FROM obs GROUP BY slot)
SELECT slot, round(l[least(CAST(floor(len(l) * 0.1) AS BIGINT) + 1, len(l))], 6) AS p10, round(l[least(CAST(floor(len(l) * 0.5) AS BIGINT) + 1, len(l))], 6) AS p50,
       round(l[least(CAST(floor(len(l) * 0.9) AS BIGINT) + 1, len(l))], 6) AS p90 FROM o
""",
)
def percentile_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each slot without interpolation."""
    at = lambda q: lambda n: F.least(F.floor(n * q), n - 1)
    found = metrics.order_statistics(observations(spark, sf_dir), ["slot"], "p", {"p10": at(0.1), "p50": at(0.5), "p90": at(0.9)})
    return found.select("slot", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")))


@_R.add(
    "latency_medians",
    OBS + "SELECT camera, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median FROM obs GROUP BY camera",
)
def latency_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and exact median of each stage."""
    rows = observations(spark, sf_dir)
    means = rows.groupBy("camera").agg(F.round(F.avg("p"), 6).alias("mean"))
    return means.join(metrics.medians(rows, ["camera"], "p"), "camera").select("camera", "mean", F.round("median", 6).alias("median"))


@_R.add(
    "three_state_closed",
    OBS + "SELECT CASE WHEN p BETWEEN 0.35 AND 0.56 THEN 'uncertain' WHEN p >= 0.5 THEN 'occupied' ELSE 'vacant' END AS state, count(*) AS n FROM obs GROUP BY 1",
)
def three_state_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with a band whose edges are uncertain."""
    return observations(spark, sf_dir).groupBy(closed_band(F.col("p"), 0.35, 0.56, 0.5).alias("state")).agg(F.count("*").alias("n"))


@_R.add(
    "three_state_open",
    OBS + "SELECT CASE WHEN p >= 0.65 THEN 'occupied' WHEN p <= 0.35 THEN 'vacant' ELSE 'uncertain' END AS state, count(*) AS n FROM obs GROUP BY 1",
)
def three_state_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with a band whose edges are settled."""
    return observations(spark, sf_dir).groupBy(open_band(F.col("p"), 0.35, 0.65).alias("state")).agg(F.count("*").alias("n"))


@_R.add(
    "fusion_logodds",
    OBS
    + """
, l AS (SELECT id, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z, slot % 3 AS k FROM obs),
t AS (SELECT id, 0.39 + 1.04 * z + CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN -0.34 ELSE -1.16 * 0.9 + 0.17 * 0.5 + 1.46 * 0.8 END AS total FROM l),
f AS (SELECT id, 1 / (1 + exp(-greatest(least(total, 40), -40))) AS q FROM t)
SELECT id, round(q, 6) AS probability, round(greatest(q, 1 - q), 6) AS confidence,
       CASE WHEN q >= 0.65 THEN 'occupied' WHEN q <= 0.35 THEN 'vacant' ELSE 'uncertain' END AS state FROM f
""",
)
def fusion_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier, detector and coverage fused: no detector, no vehicle and a vehicle are three things."""
    kind = F.col("slot") % 3
    evidence = contributions(F.col("p"), FITTED_WEIGHTS, available=kind != 0, detected=kind == 2, confidence=F.lit(0.9), slot_share=F.lit(0.5), vehicle_share=F.lit(0.8))
    fused = observations(spark, sf_dir).select("id", fuse(evidence, FITTED_WEIGHTS).alias("q"))
    return fused.select("id", F.round("q", 6).alias("probability"), F.round(confidence(F.col("q")), 6).alias("confidence"), open_band(F.col("q"), 0.35, 0.65).alias("state"))


@_R.add(
    "fusion_default",
    OBS + "SELECT camera, round(avg(abs(least(greatest(p, 1e-6), 1 - 1e-6) - p)), 8) AS shift, count(*) AS n FROM obs GROUP BY camera",
)
def fusion_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under default weights the fused probability is the classifier's, up to the clamp."""
    fused = observations(spark, sf_dir).withColumn("q", fuse(contributions(F.col("p")), DEFAULT_WEIGHTS))
    return fused.groupBy("camera").agg(F.round(F.avg(F.abs(F.col("q") - F.col("p"))), 8).alias("shift"), F.count("*").alias("n"))


@_R.add(
    "tempered_scores",
    OBS
    + """
SELECT camera, round(avg(1 / (1 + exp(-greatest(least(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) / 1.5, 40), -40)))), 6) AS mean_p
FROM obs GROUP BY camera
""",
)
def tempered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability at a temperature of 1.5."""
    return observations(spark, sf_dir).groupBy("camera").agg(F.round(F.avg(sigmoid(logit(F.col("p")) / 1.5)), 6).alias("mean_p"))


@_R.add(
    "rolling_median",
    OBS
    + """
SELECT id, round(quantile_cont(p, 0.5) OVER (PARTITION BY slot ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS median FROM obs
""",
)
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of each slot's last three readings."""
    return temporal.rolling_median(observations(spark, sf_dir), "slot", ["ts", "id"], "p", 3).select("id", F.round("median", 6).alias("median"))


_SMOOTH = OBS.replace("WITH obs", "WITH RECURSIVE obs") + """
, m AS (SELECT slot, id, row_number() OVER w AS n, quantile_cont(p, 0.5) OVER (PARTITION BY slot ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x
        FROM obs WINDOW w AS (PARTITION BY slot ORDER BY ts, id)),
f AS (
  SELECT slot, id, n, x AS ema, x >= 0.5 AS state, 0 AS pending, FALSE AS changed FROM m WHERE n = 1
  UNION ALL
  SELECT slot, id, n, ema, CASE WHEN pend >= 2 THEN NOT was ELSE was END, CASE WHEN pend >= 2 THEN 0 ELSE pend END, pend >= 2
  FROM (SELECT m.slot, m.id, m.n, 0.6 * f.ema + 0.4 * m.x AS ema, f.state AS was,
               CASE WHEN (NOT f.state AND 0.6 * f.ema + 0.4 * m.x >= 0.5 + 0.08) OR (f.state AND 0.6 * f.ema + 0.4 * m.x <= 0.5 - 0.08) THEN f.pending + 1 ELSE 0 END AS pend
        FROM f JOIN m ON m.slot = f.slot AND m.n = f.n + 1))
"""


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and the smoother's answer, in the order of (ts, id)."""
    return temporal.smooth(observations(spark, sf_dir), "slot", "ts", "p", keep=["id", "camera"], then=["id"])


@_R.add("ema_series", _SMOOTH + "SELECT id, round(ema, 6) AS ema FROM f")
def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean of each slot's medians."""
    return smoothed(spark, sf_dir).select("id", F.round("ema", 6).alias("ema"))


@_R.add("hysteresis_events", _SMOOTH + "SELECT slot, id, NOT state AS previous, state AS next, round(ema, 6) AS probability FROM f WHERE changed")
def hysteresis_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state that lasted long enough."""
    changed = smoothed(spark, sf_dir).where("changed")
    return changed.select("slot", "id", (~F.col("state")).alias("previous"), F.col("state").alias("next"), F.round("ema", 6).alias("probability"))


@_R.add("final_states", _SMOOTH + "SELECT slot, arg_max(state, n) AS state, max(n) AS readings FROM f GROUP BY slot")
def final_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slot's last state."""
    return smoothed(spark, sf_dir).groupBy("slot").agg(F.max_by("state", F.struct("ts", "id")).alias("state"), F.count("*").alias("readings"))


@_R.add(
    "transition_counts",
    OBS
    + """
, l AS (SELECT slot, p >= 0.5 AS s, lag(p >= 0.5) OVER (PARTITION BY slot ORDER BY ts, id) AS b FROM obs)
SELECT slot, count(*) FILTER (WHERE b IS NOT NULL AND s <> b) AS transitions FROM l GROUP BY slot
""",
)
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between consecutive raw verdicts of a slot."""
    state = F.col("p") >= 0.5
    before = F.lag(state).over(Window.partitionBy("slot").orderBy("ts", "id"))
    marked = observations(spark, sf_dir).withColumn("change", before.isNotNull() & (state != before))
    return marked.groupBy("slot").agg(F.count_if("change").alias("transitions"))


@_R.add(
    "video_frame_counts",
    OBS
    + """
SELECT camera, date_trunc('day', ts) AS frame, count(*) AS total, count(*) FILTER (WHERE p >= 0.65) AS occupied_spaces,
       count(*) FILTER (WHERE p > 0.35 AND p < 0.65) AS uncertain_spaces,
       count(*) - count(*) FILTER (WHERE p >= 0.65) - count(*) FILTER (WHERE p > 0.35 AND p < 0.65) AS vacant_spaces,
       round(avg(greatest(p, 1 - p)), 6) AS average_confidence
FROM obs GROUP BY 1, 2
""",
)
def video_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied, uncertain and vacant slots of each frame; the three add up to all."""
    state = open_band(F.col("p"), 0.35, 0.65)
    frames = observations(spark, sf_dir).groupBy("camera", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("frame"))
    occupied, unsure = F.count_if(state == "occupied"), F.count_if(state == "uncertain")
    return frames.agg(
        F.count("*").alias("total"), occupied.alias("occupied_spaces"), unsure.alias("uncertain_spaces"),
        (F.count("*") - occupied - unsure).alias("vacant_spaces"), F.round(F.avg(confidence(F.col("p"))), 6).alias("average_confidence"),
    )


@_R.add(
    "motion_gated_counts",
    OBS
    + """
, f AS (SELECT camera, date_trunc('day', ts) AS frame, avg(p) AS stability, count(*) FILTER (WHERE truth) AS occupied FROM obs GROUP BY 1, 2)
SELECT camera, frame, CASE WHEN stability < 0.42 THEN 'uncertain_camera_motion' ELSE 'observed' END AS status, CASE WHEN stability >= 0.42 THEN occupied END AS occupied_spaces FROM f
""",
)
def motion_gated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a moving camera have a status and no counts."""
    frames = observations(spark, sf_dir).groupBy("camera", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("frame"))
    counted = frames.agg(F.avg("p").alias("stability"), F.count_if("truth").alias("occupied"))
    still = F.col("stability") >= 0.42
    return counted.select("camera", "frame", F.when(still, "observed").otherwise("uncertain_camera_motion").alias("status"), F.when(still, F.col("occupied")).alias("occupied_spaces"))


@_R.add("last_observed", OBS + "SELECT camera, arg_max(id, (ts, id)) AS id, round(arg_max(p, (ts, id)), 6) AS p FROM obs WHERE p >= 0.1 GROUP BY camera")
def last_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last usable reading of each camera."""
    order = F.struct("ts", "id")
    return observations(spark, sf_dir).where("p >= 0.1").groupBy("camera").agg(F.max_by("id", order).alias("id"), F.round(F.max_by("p", order), 6).alias("p"))


@_R.add(
    "playback_point",
    OBS
    + """
, r AS (SELECT camera, id, row_number() OVER (PARTITION BY camera ORDER BY ts, id) - 1 AS k, count(*) OVER (PARTITION BY camera) AS n FROM obs),
q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS position)
SELECT camera, position, id FROM r JOIN q ON k = least(CAST(floor(position * n) AS BIGINT), n - 1)
""",
)
def playback_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading shown at a share of the playing time."""
    rows = with_places(observations(spark, sf_dir), ["camera"], ["ts", "id"], "k", "n")
    position = F.explode(F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    spots = rows.groupBy("camera").agg(F.count("*").alias("n")).select("camera", "n", position.alias("position"))
    spots = spots.select("camera", "position", F.least(F.floor(F.col("position") * F.col("n")), F.col("n") - 1).alias("k"))
    return spots.join(rows, ["camera", "k"]).select("camera", F.col("position").cast("decimal(3,2)").alias("position"), "id")


@_R.add(
    "gaps_and_islands",
    OBS
    + """
, g AS (SELECT slot, p, CASE WHEN p - lag(p) OVER (PARTITION BY slot ORDER BY p) > 0.05 THEN 1 ELSE 0 END AS gap FROM obs),
i AS (SELECT slot, p, sum(gap) OVER (PARTITION BY slot ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT slot, CAST(max(island) + 1 AS BIGINT) AS islands FROM i GROUP BY slot
""",
)
def gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of readings no more than 0.05 apart."""
    return temporal.islands(observations(spark, sf_dir), ["slot"], "p", 0.05).groupBy("slot").agg((F.max("island") + 1).alias("islands"))


@_R.add(
    "interval_union",
    OBS
    + """
, s AS (SELECT slot, p AS low, p + 0.02 AS high FROM obs),
r AS (SELECT slot, low, high, max(high) OVER (PARTITION BY slot ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT slot, round(sum(greatest(high - greatest(coalesce(reach, low), low), 0)), 6) AS covered FROM r GROUP BY slot
""",
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length that a slot's intervals cover together."""
    spans = observations(spark, sf_dir).select("slot", F.col("p").alias("low"), (F.col("p") + 0.02).alias("high"))
    return temporal.union_length(spans, ["slot"], "low", "high").select("slot", F.round("covered", 6).alias("covered"))


_GRID = OBS + """
, g AS (SELECT i, {low} + i * {step} AS threshold FROM range({n}) t(i)),
c AS (SELECT {group} i, threshold, count(*) FILTER (WHERE round(p, 9) >= round(threshold, 9) AND truth) AS tp, count(*) FILTER (WHERE round(p, 9) < round(threshold, 9) AND NOT truth) AS tn,
             count(*) FILTER (WHERE round(p, 9) >= round(threshold, 9) AND NOT truth) AS fp, count(*) FILTER (WHERE round(p, 9) < round(threshold, 9) AND truth) AS fn
      FROM obs CROSS JOIN g GROUP BY ALL),
b AS (SELECT *, round((coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) + coalesce(tn * 1.0 / nullif(tn + fp, 0), 0)) / 2, 6) AS ba FROM c)
"""


@_R.add(
    "threshold_grid",
    _GRID.format(low="0.2", step="0.005", n=121, group="camera,")
    + """
, w AS (SELECT i, threshold, min(ba) AS worst, round(sum(tp) * 0.5 / nullif(sum(tp + fn), 0) + sum(tn) * 0.5 / nullif(sum(tn + fp), 0) - 0.25 * sum(fn) / greatest(sum(tp + fn), 1), 6) AS overall FROM b GROUP BY ALL)
SELECT round(arg_max(threshold, (worst, overall, -round(abs(threshold - 0.5), 6), -i)), 6) AS threshold FROM w
""",
)
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the best worst camera, then of accuracy less false vacancies, then nearest one half."""
    counts = selection.by_threshold(observations(spark, sf_dir), ["camera"], "p", "truth", 0.2, 0.005, 121)
    tp, tn, fp, fn = (F.sum(c) for c in ("tp", "tn", "fp", "fn"))
    overall = tp * 0.5 / (tp + fn) + tn * 0.5 / (tn + fp) - 0.25 * fn / F.greatest(tp + fn, F.lit(1))
    points = counts.withColumn("ba", F.round(selection.balanced_accuracy(), 6)).groupBy("i", "threshold").agg(F.min("ba").alias("worst"), F.round(overall, 6).alias("overall"))
    objective = [F.col("worst"), F.col("overall"), -F.round(F.abs(F.col("threshold") - 0.5), 6), -F.col("i")]
    return selection.best(points, objective, ["threshold"]).select(F.round("threshold", 6).alias("threshold"))


@_R.add(
    "threshold_grid_first",
    _GRID.format(low="0.2", step="0.025", n=25, group="") + "SELECT round(arg_max(threshold, (ba, -i)), 6) AS threshold, max(ba) AS balanced_accuracy FROM b",
)
def threshold_grid_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first threshold of the best balanced accuracy over all cameras."""
    counts = selection.by_threshold(observations(spark, sf_dir), [], "p", "truth", 0.2, 0.025, 25).withColumn("ba", F.round(selection.balanced_accuracy(), 6))
    return selection.best(counts, [F.col("ba"), -F.col("i")], ["threshold", "ba"]).select(F.round("threshold", 6).alias("threshold"), F.col("ba").alias("balanced_accuracy"))


@_R.add("operating_points", _GRID.format(low="0.1", step="0.1", n=9, group="camera,") + "SELECT camera, round(threshold, 6) AS threshold, tp, fp, fn, tn FROM b")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each camera at nine thresholds."""
    counts = selection.by_threshold(observations(spark, sf_dir), ["camera"], "p", "truth", 0.1, 0.1, 9)
    return counts.select("camera", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn")


@_R.add(
    "band_grid_narrowest",
    OBS
    + """
, h AS (SELECT CAST(floor(round(p, 9) * 50) AS INTEGER) AS bin, count(*) FILTER (WHERE truth) AS yes, count(*) FILTER (WHERE NOT truth) AS no FROM obs GROUP BY 1),
g AS (SELECT a AS low, b AS high FROM range(0, 26) t(a) CROSS JOIN range(25, 51) u(b)),
e AS (SELECT low, high, sum(CASE WHEN bin < low THEN yes WHEN bin >= high THEN no ELSE 0 END) * 1.0 / greatest(sum(CASE WHEN bin < low OR bin >= high THEN yes + no ELSE 0 END), 1) AS error FROM h CROSS JOIN g GROUP BY 1, 2)
SELECT arg_min(low, (high - low, low, high)) / 50.0 AS lower, arg_min(high, (high - low, low, high)) / 50.0 AS upper FROM e WHERE error <= 0.495
""",
)
def band_grid_narrowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest band outside of which at most so many verdicts are wrong; the first of equals.

    Readings are counted in fiftieths first: the grid multiplies 51 rows, not the readings.
    """
    rows = observations(spark, sf_dir).groupBy(F.floor(F.round("p", 9) * 50).alias("bin")).agg(F.count_if("truth").alias("yes"), F.count_if(~F.col("truth")).alias("no"))
    edges = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    spread = rows.select("*", edges(0, 25).alias("low")).select("*", edges(25, 50).alias("high"))
    below, above = F.col("bin") < F.col("low"), F.col("bin") >= F.col("high")
    wrong = F.sum(F.when(below, F.col("yes")).when(above, F.col("no")).otherwise(0))
    settled = F.sum(F.when(below | above, F.col("yes") + F.col("no")).otherwise(0))
    bands = spread.groupBy("low", "high").agg((wrong / F.greatest(settled, F.lit(1))).alias("error")).where("error <= 0.495")
    order = F.struct((F.col("high") - F.col("low")).alias("w"), "low", "high")
    return bands.agg((F.min_by("low", order) / 50.0).alias("lower"), (F.min_by("high", order) / 50.0).alias("upper"))
