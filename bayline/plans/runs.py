"""Run history queries: orders are runs, their lineitems are slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bayline.plans.registry import Registry
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: slot counts, mean confidence and the rate of occupied slots."""
    slots = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("total_spaces"),
            F.count_if(F.col("l_returnflag") == "R").alias("occupied_spaces"),
            F.avg("l_discount").alias("average_confidence"),
        )
    )
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("processing_time_ms"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("media_id"),
    )
    return runs.join(slots, runs.run_id == slots.l_orderkey).drop("l_orderkey")


RUNS_SQL = """
WITH slots AS (
  SELECT l_orderkey, count(*) AS total_spaces,
         count(*) FILTER (WHERE l_returnflag = 'R') AS occupied_spaces,
         avg(l_discount) AS average_confidence
  FROM lineitem GROUP BY l_orderkey),
runs AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS dataset, o_orderdate AS created_at,
         o_totalprice AS processing_time_ms, o_orderstatus AS status, o_custkey AS media_id,
         total_spaces, occupied_spaces, average_confidence
  FROM orders JOIN slots ON o_orderkey = l_orderkey)
"""


@_R.add(
    "run_breakdown",
    RUNS_SQL
    + """
SELECT dataset, count(*) AS runs, CAST(sum(total_spaces) AS BIGINT) AS spaces,
       round(sum(occupied_spaces) * 1.0 / nullif(sum(total_spaces), 0), 6) AS occupancy_rate,
       round(avg(average_confidence), 6) AS average_confidence,
       round(avg(processing_time_ms), 4) AS average_time_ms
FROM runs GROUP BY dataset
""",
)
def run_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, slots, pooled occupancy rate and null-safe means of each dataset."""
    return (
        run_table(spark, sf_dir)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("runs"),
            F.sum("total_spaces").alias("spaces"),
            F.round(F.try_divide(F.sum("occupied_spaces"), F.sum("total_spaces")), 6).alias("occupancy_rate"),
            F.round(F.avg("average_confidence"), 6).alias("average_confidence"),
            F.round(F.avg("processing_time_ms"), 4).alias("average_time_ms"),
        )
    )


@_R.add(
    "run_summary",
    RUNS_SQL
    + """
SELECT count(*) AS total_runs, CAST(sum(total_spaces) AS BIGINT) AS total_spaces,
       CAST(sum(occupied_spaces) AS BIGINT) AS occupied_spaces,
       CAST(sum(total_spaces - occupied_spaces) AS BIGINT) AS vacant_spaces,
       round(avg(average_confidence), 6) AS average_confidence,
       round(avg(processing_time_ms) FILTER (WHERE status <> 'P'), 4) AS image_time_ms,
       round(avg(processing_time_ms) FILTER (WHERE status = 'P'), 4) AS video_time_ms,
       count(*) FILTER (WHERE status = 'F') AS runs_with_truth
FROM runs
""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all runs; image and video times never blend."""
    video = F.col("status") == "P"
    return run_table(spark, sf_dir).agg(
        F.count("*").alias("total_runs"),
        F.sum("total_spaces").alias("total_spaces"),
        F.sum("occupied_spaces").alias("occupied_spaces"),
        F.sum(F.col("total_spaces") - F.col("occupied_spaces")).alias("vacant_spaces"),
        F.round(F.avg("average_confidence"), 6).alias("average_confidence"),
        F.round(F.avg(F.when(~video, F.col("processing_time_ms"))), 4).alias("image_time_ms"),
        F.round(F.avg(F.when(video, F.col("processing_time_ms"))), 4).alias("video_time_ms"),
        F.count_if(F.col("status") == "F").alias("runs_with_truth"),
    )


@_R.add(
    "run_history_topn",
    RUNS_SQL
    + """
SELECT run_id, dataset, total_spaces, occupied_spaces,
       round(coalesce(occupied_spaces * 1.0 / nullif(total_spaces, 0), 0), 6) AS occupancy_rate,
       round(average_confidence, 6) AS average_confidence
FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 25
""",
)
def run_history_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 latest runs; the larger id among equal times."""
    newest = run_table(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("run_id")).limit(25)
    return newest.select(
        "run_id", "dataset", "total_spaces", "occupied_spaces",
        F.round(F.coalesce(F.try_divide("occupied_spaces", "total_spaces"), F.lit(0.0)), 6).alias("occupancy_rate"),
        F.round("average_confidence", 6).alias("average_confidence"),
    )


@_R.add(
    "recent_runs",
    RUNS_SQL
    + """
, latest AS (SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 10)
SELECT run_id, dataset, CAST(row_number() OVER (ORDER BY created_at, run_id) AS INTEGER) AS place FROM latest
""",
)
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest runs, numbered from the oldest of them on."""
    latest = run_table(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("run_id")).limit(10)
    return latest.select("run_id", "dataset", F.row_number().over(Window.orderBy("created_at", "run_id")).alias("place"))


@_R.add(
    "dashboard_counts",
    RUNS_SQL
    + """
SELECT count(*) AS runs, count(DISTINCT dataset) AS datasets, arg_max(run_id, (created_at, run_id)) AS latest_run,
       arg_max(occupied_spaces, (created_at, run_id)) AS latest_occupied FROM runs
""",
)
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts beside the latest run."""
    order = F.struct("created_at", "run_id")
    return run_table(spark, sf_dir).agg(
        F.count("*").alias("runs"),
        F.count_distinct("dataset").alias("datasets"),
        F.max_by("run_id", order).alias("latest_run"),
        F.max_by("occupied_spaces", order).alias("latest_occupied"),
    )


@_R.add(
    "benchmark_vs_user_split",
    """
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'benchmark' ELSE 'user' END AS kind,
       count(*) AS runs, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS cameras
FROM events GROUP BY 1
""",
)
def benchmark_vs_user_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on known datasets against all others."""
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "benchmark").otherwise("user")
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(
        F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_distinct("user_id").alias("cameras")
    )


@_R.add(
    "throughput",
    """
SELECT o_orderkey AS video_id, round(CASE WHEN o_totalprice > 0 THEN count(*) / (o_totalprice / 1000) END, 3) AS frames_per_second
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey, o_totalprice
""",
)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames for each second of processing; null unless the time is positive."""
    videos = run_table(spark, sf_dir).where("status = 'P'")
    rate = F.when(F.col("processing_time_ms") > 0, F.col("total_spaces") / (F.col("processing_time_ms") / 1000))
    return videos.select(F.col("run_id").alias("video_id"), F.round(rate, 3).alias("frames_per_second"))


@_R.add(
    "weighted_agreement",
    RUNS_SQL
    + """
SELECT dataset, round(sum(average_confidence * total_spaces) / sum(total_spaces), 6) AS agreement, round(avg(processing_time_ms), 4) AS mean_time_ms
FROM runs GROUP BY dataset
""",
)
def weighted_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement weighted by slots, and the mean time."""
    agreement = F.sum(F.col("average_confidence") * F.col("total_spaces")) / F.sum("total_spaces")
    return run_table(spark, sf_dir).groupBy("dataset").agg(F.round(agreement, 6).alias("agreement"), F.round(F.avg("processing_time_ms"), 4).alias("mean_time_ms"))


@_R.add(
    "media_name_left_join",
    RUNS_SQL
    + """
SELECT run_id, coalesce(nullif(c_name, ''), dataset) AS display_name FROM runs
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'FURNITURE') c ON media_id = c_custkey
""",
)
def media_name_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their media's name; the dataset where there is none."""
    names = table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'").select("c_custkey", "c_name")
    runs = run_table(spark, sf_dir)
    return runs.join(names, runs.media_id == names.c_custkey, "left").select("run_id", F.coalesce(F.nullif("c_name", F.lit("")), "dataset").alias("display_name"))


@_R.add(
    "three_way_annotation_join",
    """
SELECT n_name AS camera, c_mktsegment AS slot_kind, count(*) AS labelled,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS occupied
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""",
)
def three_way_annotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their slot and their camera, two equality joins."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.groupBy(F.col("n_name").alias("camera"), F.col("c_mktsegment").alias("slot_kind")).agg(
        F.count("*").alias("labelled"), F.count_if(F.col("o_orderstatus") == "F").alias("occupied")
    )


@_R.add(
    "showcase_rank",
    RUNS_SQL
    + """
SELECT dataset, arg_min(run_id, (CASE WHEN status = 'O' THEN 1 ELSE 0 END, -least(occupied_spaces, total_spaces - occupied_spaces), -total_spaces, run_id)) AS run_id
FROM runs GROUP BY dataset
""",
)
def showcase_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each dataset the run to show: not from training, most of the rarer state, most slots."""
    minority = F.least(F.col("occupied_spaces"), F.col("total_spaces") - F.col("occupied_spaces"))
    order = F.struct((F.col("status") == "O").cast("int").alias("a"), (-minority).alias("b"), (-F.col("total_spaces")).alias("c"), F.col("run_id").alias("d"))
    return run_table(spark, sf_dir).groupBy("dataset").agg(F.min_by("run_id", order).alias("run_id"))
