"""Queries that hold one thing against another: modes, models, splits, halves of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bayline.functions import hashing
from bayline.operators import dedupe, metrics, selection, temporal
from bayline.plans.observations import OBS, observations
from bayline.plans.catalogues import classes_sql, with_hash
from bayline.plans.registry import Registry
from bayline.plans.runs import RUNS_SQL, run_table
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add(
    "image_vs_video_means",
    RUNS_SQL
    + """
SELECT round(avg(processing_time_ms) FILTER (WHERE status <> 'P'), 4) AS image_ms, round(avg(processing_time_ms) FILTER (WHERE status = 'P'), 4) AS video_ms,
       count(*) FILTER (WHERE status <> 'P') AS images, count(*) FILTER (WHERE status = 'P') AS videos FROM runs
""",
)
def image_vs_video_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean times of images and of videos, never of both."""
    video = F.col("status") == "P"
    time = lambda c: F.round(F.avg(F.when(c, F.col("processing_time_ms"))), 4)
    return run_table(spark, sf_dir).agg(time(~video).alias("image_ms"), time(video).alias("video_ms"), F.count_if(~video).alias("images"), F.count_if(video).alias("videos"))


@_R.add(
    "binary_metrics_nullable",
    OBS
    + """
, c AS (SELECT slot, count(*) FILTER (WHERE p >= 0.9 AND truth) AS tp, count(*) FILTER (WHERE p < 0.9 AND NOT truth) AS tn,
               count(*) FILTER (WHERE p >= 0.9 AND NOT truth) AS fp, count(*) FILTER (WHERE p < 0.9 AND truth) AS fn FROM obs GROUP BY slot)
SELECT slot, round(tp * 1.0 / nullif(tp + fp, 0), 6) AS "precision", round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall FROM c
""",
)
def binary_metrics_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of slots over all their readings; null where a slot has no denominator."""
    rows = observations(spark, sf_dir).groupBy("slot").agg(*metrics.confusion(F.col("p") >= 0.9, F.col("truth")))
    return metrics.nullable_metrics(rows).select("slot", "precision", "recall")


@_R.add(
    "binary_metrics_by_day",
    OBS
    + """
, c AS (SELECT slot, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS readings, count(*) FILTER (WHERE p >= 0.9 AND truth) AS tp, count(*) FILTER (WHERE p < 0.9 AND NOT truth) AS tn,
               count(*) FILTER (WHERE p >= 0.9 AND NOT truth) AS fp, count(*) FILTER (WHERE p < 0.9 AND truth) AS fn FROM obs GROUP BY 1, 2)
SELECT slot, day, readings, round(tp * 1.0 / nullif(tp + fp, 0), 6) AS "precision", round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall FROM c
""",
)
def binary_metrics_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each slot and day over all readings; null where a day has no denominator."""
    days = observations(spark, sf_dir).groupBy("slot", F.to_date("ts").cast("string").alias("day"))
    rows = days.agg(F.count("*").alias("readings"), *metrics.confusion(F.col("p") >= 0.9, F.col("truth")))
    return metrics.nullable_metrics(rows).select("slot", "day", "readings", "precision", "recall")


@_R.add(
    "pair_assembly",
    """
SELECT a.l_orderkey AS pair_key, a.n AS images, b.n AS annotations FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a
JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b USING (l_orderkey)
""",
)
def pair_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have both members of a pair; one pass over the table, no join."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_key")).agg(
        F.count_if(F.col("l_linestatus") == "O").alias("images"), F.count_if(F.col("l_linestatus") == "F").alias("annotations")
    )
    return counts.where("images > 0 and annotations > 0")


@_R.add("near_duplicate_pairs", classes_sql("documents", "doc_id", "text", 1))
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts at most one SimHash bit apart: members of each class of equal hashes with its least id, and near classes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedupe.hamming_classes(with_hash(docs, "text"), "id", "hash", 1)


@_R.add("near_text_classes", classes_sql("documents", "doc_id", "text", 3))
def near_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at most 3 bits apart. Texts without a word are in no class."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedupe.hamming_classes(with_hash(docs, "text"), "id", "hash", 3)


@_R.add(
    "paired_models",
    OBS
    + """
, m AS (SELECT camera, (p >= 0.5) = truth AS base, (p >= 0.35) = truth AS better FROM obs)
SELECT coalesce(camera, 'ALL') AS camera, round(avg(CAST(base AS INTEGER)), 6) AS base_accuracy, round(avg(CAST(better AS INTEGER)), 6) AS better_accuracy,
       count(*) FILTER (WHERE better AND NOT base) AS gained, count(*) FILTER (WHERE base AND NOT better) AS lost FROM m GROUP BY ROLLUP (camera)
""",
)
def paired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts on the same readings, of each camera and overall."""
    rows = observations(spark, sf_dir).select("camera", ((F.col("p") >= 0.5) == F.col("truth")).alias("base"), ((F.col("p") >= 0.35) == F.col("truth")).alias("better"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return rows.rollup("camera").agg(
        share("base").alias("base_accuracy"), share("better").alias("better_accuracy"),
        F.count_if(F.col("better") & ~F.col("base")).alias("gained"), F.count_if(F.col("base") & ~F.col("better")).alias("lost"),
    ).withColumn("camera", F.coalesce("camera", F.lit("ALL")))


@_R.add(
    "mode_comparison",
    RUNS_SQL
    + """
, d AS (SELECT media_id, avg(occupied_spaces) FILTER (WHERE status = 'F') AS benchmark, avg(occupied_spaces) FILTER (WHERE status <> 'F') AS product FROM runs GROUP BY media_id)
SELECT media_id, round(benchmark, 6) AS benchmark_occupied, round(product, 6) AS product_occupied, round(product - benchmark, 6) AS difference FROM d WHERE benchmark IS NOT NULL AND product IS NOT NULL
""",
)
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark and product results of a scene side by side; scenes that lack one of them go."""
    mean = lambda c: F.avg(F.when(c, F.col("occupied_spaces")))
    benchmark = F.col("status") == "F"
    scenes = run_table(spark, sf_dir).groupBy("media_id").agg(mean(benchmark).alias("b"), mean(~benchmark).alias("p")).dropna()
    return scenes.select("media_id", F.round("b", 6).alias("benchmark_occupied"), F.round("p", 6).alias("product_occupied"), F.round(F.col("p") - F.col("b"), 6).alias("difference"))


@_R.add(
    "known_unseen_gap",
    OBS
    + """
, a AS (SELECT slot % 10 AS grp, avg(CAST((p >= 0.5) = truth AS INTEGER)) FILTER (WHERE slot % 3 = 0) AS known, avg(CAST((p >= 0.5) = truth AS INTEGER)) FILTER (WHERE slot % 3 = 1 AND slot > 60) AS unseen FROM obs GROUP BY 1)
SELECT grp, round(known - unseen, 6) AS gap FROM a
""",
)
def known_unseen_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on known cameras less that on unseen ones; null where either is missing."""
    right = ((F.col("p") >= 0.5) == F.col("truth")).cast("int")
    mean = lambda c: F.avg(F.when(c, right))
    known, unseen = F.col("slot") % 3 == 0, (F.col("slot") % 3 == 1) & (F.col("slot") > 60)
    return observations(spark, sf_dir).groupBy((F.col("slot") % 10).alias("grp")).agg(F.round(mean(known) - mean(unseen), 6).alias("gap"))


@_R.add(
    "uncertain_band_choice",
    OBS
    + """
, h AS (SELECT CAST(floor(round(p, 9) * 40) AS INTEGER) AS bin, count(*) FILTER (WHERE truth) AS yes, count(*) FILTER (WHERE NOT truth) AS no FROM obs GROUP BY 1),
g AS (SELECT a AS low, b AS high FROM range(10, 20) t(a) CROSS JOIN range(21, 31) u(b)),
c AS (SELECT low, high, sum(CASE WHEN bin >= high THEN yes ELSE 0 END) AS tp, sum(CASE WHEN bin < low THEN no ELSE 0 END) AS tn, sum(CASE WHEN bin >= high THEN no ELSE 0 END) AS fp,
             sum(CASE WHEN bin < low THEN yes ELSE 0 END) AS fn, sum(yes + no) AS n FROM h CROSS JOIN g GROUP BY 1, 2),
s AS (SELECT low, high, (tp + tn + fp + fn) * 1.0 / n AS coverage, round((coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) + coalesce(tn * 1.0 / nullif(tn + fp, 0), 0)) / 2 - 0.05 * (1 - (tp + tn + fp + fn) * 1.0 / n), 6) AS score FROM c)
SELECT arg_max(low, (score, -low, -high)) / 40.0 AS lower, arg_max(high, (score, -low, -high)) / 40.0 AS upper, max(score) AS score FROM s WHERE coverage >= 0.7
""",
)
def uncertain_band_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of the best balanced accuracy less a price for what it leaves open; coverage 0.7 at least."""
    edges = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    bins = observations(spark, sf_dir).groupBy(F.floor(F.round("p", 9) * 40).alias("bin")).agg(F.count_if("truth").alias("yes"), F.count_if(~F.col("truth")).alias("no"))
    spread = bins.select("*", edges(10, 19).alias("low")).select("*", edges(21, 30).alias("high"))
    above, below = F.col("bin") >= F.col("high"), F.col("bin") < F.col("low")
    total = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    counts = spread.groupBy("low", "high").agg(
        total(above, "yes").alias("tp"), total(below, "no").alias("tn"), total(above, "no").alias("fp"), total(below, "yes").alias("fn"), F.sum(F.col("yes") + F.col("no")).alias("n")
    )
    coverage = (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")) / F.col("n")
    scored = counts.withColumn("coverage", coverage).withColumn("score", F.round(selection.balanced_accuracy() - 0.05 * (1 - F.col("coverage")), 6)).where("coverage >= 0.7")
    best = selection.best(scored, [F.col("score"), -F.col("low"), -F.col("high")], ["low", "high", "score"])
    return best.select((F.col("low") / 40.0).alias("lower"), (F.col("high") / 40.0).alias("upper"), "score")


@_R.add(
    "acceptance_scorecard",
    """
WITH c AS (SELECT r_regionkey, r_name AS check_name FROM region), m AS (SELECT n_regionkey AS k, round(avg(s_acctbal), 2) AS measured FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey < 4 GROUP BY 1)
SELECT check_name, coalesce(CAST(measured >= 4500 AS VARCHAR), 'not measured') AS accepted FROM c LEFT JOIN m ON r_regionkey = k
""",
)
def acceptance_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each check passes; one without an artifact was not measured."""
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 4").select("n_nationkey", "n_regionkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    measured = nations.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_regionkey").agg(F.round(F.avg("s_acctbal"), 2).alias("measured"))
    checks = table(spark, sf_dir, "region")
    joined = checks.join(measured, checks.r_regionkey == measured.n_regionkey, "left")
    return joined.select(F.col("r_name").alias("check_name"), F.coalesce((F.col("measured") >= 4500).cast("string"), F.lit("not measured")).alias("accepted"))


@_R.add(
    "longest_sequences",
    OBS
    + """
, s AS (SELECT camera, slot, count(*) AS size, count(DISTINCT truth) AS kinds FROM obs GROUP BY 1, 2)
SELECT camera, slot, size FROM (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY size DESC, slot) AS n FROM s WHERE size >= 8 AND kinds = 2) WHERE n <= 2
""",
)
def longest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two longest sequences of each camera, eight readings or more, both states in them."""
    series = observations(spark, sf_dir).groupBy("camera", "slot").agg(F.count("*").alias("size"), F.count_distinct("truth").alias("kinds")).where("size >= 8 and kinds = 2")
    rank = F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("size"), "slot"))
    return series.withColumn("n", rank).where("n <= 2").select("camera", "slot", "size")


_SETTINGS = "(SELECT row_number() OVER (ORDER BY w, a, h, n) - 1 AS g, w, a, h, n AS hold FROM (VALUES (1), (3), (5)) x(w), (VALUES (0.3::DOUBLE), (0.5), (0.7)) y(a), (VALUES (0.04::DOUBLE), (0.08), (0.12)) z(h), (VALUES (1), (2), (3)) u(n))"


def _median_sql(window: int) -> str:
    return f"SELECT slot, id, camera, truth, row_number() OVER s AS n, {window} AS w, quantile_cont(p, 0.5) OVER (PARTITION BY slot ORDER BY ts, id ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS x FROM obs WINDOW s AS (PARTITION BY slot ORDER BY ts, id)"


@_R.add(
    "temporal_grid",
    OBS.replace("WITH obs", "WITH RECURSIVE obs")
    + f"""
, grid AS {_SETTINGS},
m AS ({" UNION ALL ".join(map(_median_sql, (1, 3, 5)))}),
f AS (
  SELECT slot, n, g, camera, truth, x AS ema, x >= 0.5 AS state, 0 AS pending, FALSE AS changed, FALSE AS moved FROM m JOIN grid USING (w) WHERE n = 1
  UNION ALL
  SELECT slot, n, g, camera, truth, ema, CASE WHEN pend >= hold THEN NOT was ELSE was END, CASE WHEN pend >= hold THEN 0 ELSE pend END, pend >= hold, truth <> before
  FROM (SELECT m.slot, m.n, f.g, m.camera, m.truth, f.truth AS before, hold, (1 - a) * f.ema + a * m.x AS ema, f.state AS was,
               CASE WHEN (NOT f.state AND (1 - a) * f.ema + a * m.x >= 0.5 + h) OR (f.state AND (1 - a) * f.ema + a * m.x <= 0.5 - h) THEN f.pending + 1 ELSE 0 END AS pend
        FROM f JOIN grid USING (g) JOIN m ON m.slot = f.slot AND m.n = f.n + 1 AND m.w = grid.w)),
c AS (SELECT g, camera, count(*) FILTER (WHERE state AND truth) AS tp, count(*) FILTER (WHERE NOT state AND NOT truth) AS tn, count(*) FILTER (WHERE truth) AS yes, count(*) FILTER (WHERE NOT truth) AS no FROM f GROUP BY 1, 2),
b AS (SELECT g, min(round((coalesce(tp * 1.0 / nullif(yes, 0), 0) + coalesce(tn * 1.0 / nullif(no, 0), 0)) / 2, 6)) AS worst, round(sum(yes - tp) * 1.0 / greatest(sum(yes), 1), 6) AS missed FROM c GROUP BY g),
t AS (SELECT g, CAST(sum(off) AS BIGINT) AS off FROM (SELECT g, slot, abs(count(*) FILTER (WHERE changed) - count(*) FILTER (WHERE moved)) AS off FROM f GROUP BY 1, 2) GROUP BY g),
k AS (SELECT g FROM b JOIN t USING (g) JOIN grid USING (g) ORDER BY worst DESC, missed, off, hold, g LIMIT 1)
SELECT w AS "window", a AS alpha, h AS hysteresis, hold AS persistence, worst AS worst_balanced_accuracy, missed AS false_vacant_rate, off AS transition_error FROM k JOIN grid USING (g) JOIN b USING (g) JOIN t USING (g)
""",
)
def temporal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothing parameters, of 81 settings, of the best worst camera, then of fewest false vacancies, fewest wrong changes and least persistence."""
    found = temporal.smooth_grid(observations(spark, sf_dir), "slot", "ts", "p", "truth", "camera", then=["id"])
    counts = found.groupBy("dataset", "setting").agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn", "transition_error")))
    ba = counts.withColumn("ba", F.round(selection.balanced_accuracy(), 6))
    points = ba.groupBy("setting").agg(
        F.min("ba").alias("worst_balanced_accuracy"), F.round(F.sum("fn") / F.greatest(F.sum(F.col("tp") + F.col("fn")), F.lit(1)), 6).alias("false_vacant_rate"), F.sum("transition_error").alias("transition_error")
    )
    names = ("window", "alpha", "hysteresis", "persistence")
    setting = F.array(*(F.struct(*(F.lit(getattr(g, n)).alias(n) for n in names)) for g in temporal.GRID))
    named = points.withColumn("how", F.element_at(setting, F.col("setting").cast("int") + 1)).select("*", "how.*")
    objective = [F.col("worst_balanced_accuracy"), -F.col("false_vacant_rate"), -F.col("transition_error"), -F.col("persistence"), -F.col("setting")]
    return selection.best(named, objective, [*names, "worst_balanced_accuracy", "false_vacant_rate", "transition_error"])
