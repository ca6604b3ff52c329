"""Queries whose models are fitted to the tables: fusion, temperature, calibrated margins, average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions.numbers import logit, sigmoid, tempered_sigmoid
from bayline.operators import fits, matching, running
from bayline.plans.observations import OBS, observations
from bayline.plans.registry import Registry
from bayline.plans.scenes import items, matched_sql

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles

#: Newton's steps in the SQL, far more than the fits need.
_STEPS = 12
_Z = "ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)))"
_PAGE = "CAST(regexp_extract(camera, 'view|click') <> '' AS INTEGER)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the classifier's log-odds and whether a viewing camera made them."""
    rows = observations(spark, sf_dir)
    return rows.withColumn("z", logit(F.col("p"))).withColumn("viewed", F.col("camera").rlike("view|click").cast("int"))


# Three unknowns by Cramer's rule; g and h are the penalised gradient and Hessian.
_FIT = f"""
, e AS (SELECT id, slot, truth, CAST(truth AS INTEGER) AS y, {_Z} AS z, {_PAGE} AS v FROM obs),
w AS (
  SELECT 0 AS step, k AS fold, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM (SELECT unnest({{folds}}) AS k)
  UNION ALL
  SELECT step + 1, fold,
    a - (ga * (hbb * hcc - hbc * hbc) - hab * (gb * hcc - hbc * gc) + hac * (gb * hbc - hbb * gc)) / det,
    b - (haa * (gb * hcc - hbc * gc) - ga * (hab * hcc - hbc * hac) + hac * (hab * gc - gb * hac)) / det,
    c - (haa * (hbb * gc - gb * hbc) - hab * (hab * gc - gb * hac) + ga * (hab * hbc - hbb * hac)) / det
  FROM (SELECT *, haa * (hbb * hcc - hbc * hbc) - hab * (hab * hcc - hbc * hac) + hac * (hab * hbc - hbb * hac) AS det FROM (
    SELECT step, fold, a, b, c, sum(q - y) AS ga, sum((q - y) * z) + b AS gb, sum((q - y) * v) + c AS gc, sum(q * (1 - q)) AS haa, sum(q * (1 - q) * z) AS hab, sum(q * (1 - q) * v) AS hac,
           sum(q * (1 - q) * z * z) + 1 AS hbb, sum(q * (1 - q) * z * v) AS hbc, sum(q * (1 - q) * v * v) + 1 AS hcc
    FROM (SELECT w.*, e.y, e.z, e.v, 1 / (1 + exp(-(a + b * z + c * v))) AS q FROM w JOIN e ON {{outside}} WHERE step < {_STEPS}) GROUP BY step, fold, a, b, c))),
m AS (SELECT fold, a, b, c FROM w WHERE step = {_STEPS})
"""
_RECURSIVE = OBS.replace("WITH obs", "WITH RECURSIVE obs")
FOLDS = [0, 1, 2, 3]


@_R.add("fitted_fusion", _RECURSIVE + _FIT.format(folds="[-1]", outside="TRUE") + "SELECT id, slot, round(1 / (1 + exp(-(a + b * z + c * v))), 6) AS fused FROM e, m")
def fitted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings scored by a fusion of log-odds and camera kind that is fitted to them."""
    rows = _evidence(spark, sf_dir)
    fit = fits.logistic_fit(rows, ["z", "viewed"], "truth")
    return rows.select("id", "slot", F.round(sigmoid(fit.margin()), 6).alias("fused"))


@_R.add(
    "out_of_fold_fusion",
    _RECURSIVE + _FIT.format(folds=FOLDS, outside="e.slot % 4 <> w.fold") + "SELECT fold, count(*) AS n, round(avg(CAST((a + b * z + c * v >= 0) = truth AS INTEGER)), 6) AS accuracy, round(any_value(a), 6) AS intercept, round(any_value(b), 6) AS classifier, round(any_value(c), 6) AS viewed FROM e JOIN m ON e.slot % 4 = fold GROUP BY fold",
)
def out_of_fold_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold of slots scored by the fusion that was fitted to the others, with its weights."""
    rows = _evidence(spark, sf_dir).withColumn("fold", (F.col("slot") % 4).cast("int"))
    models = fits.out_of_fold(rows, ["z", "viewed"], "truth", "fold", FOLDS)
    own = F.element_at(F.array(*(F.struct(m.margin().alias("margin"), *(F.lit(v).alias(k) for k, v in m.named().items())) for m in models.values())), F.col("fold") + 1)
    scored = rows.select("fold", "truth", own.alias("m"))
    right = ((F.col("m.margin") >= 0) == F.col("truth")).cast("int")
    first = lambda name, out: F.round(F.first(f"m.{name}"), 6).alias(out)
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), first("intercept", "intercept"), first("z", "classifier"), first("viewed", "viewed"))


@_R.add(
    "tempered_readings",
    _RECURSIVE
    + f"""
, e AS (SELECT id, CAST(truth AS INTEGER) AS y, {_Z} AS z FROM obs),
t AS (
  SELECT 0 AS step, 0.25::DOUBLE AS low, 4.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, coalesce(max(x) FILTER (s < 0), low), coalesce(min(x) FILTER (s >= 0), high)
  FROM (SELECT step, low, high, x, sum(z * (1 / (1 + exp(-x * z)) - y)) AS s FROM (SELECT step, low, high, low + (high - low) * i / 16 AS x FROM t, range(17) r(i) WHERE step < 10), e GROUP BY step, low, high, x) GROUP BY step, low, high),
k AS (SELECT 2 / (low + high) AS temperature FROM t WHERE step = 10)
SELECT id, round(1 / (1 + exp(-z / temperature)), 6) AS tempered, round(temperature, 6) AS temperature FROM e, k
""",
)
def tempered_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings at the temperature, between a quarter and four, of the least log-loss."""
    rows = _evidence(spark, sf_dir)
    found = fits.temperature(rows, "z", "truth")
    return rows.select("id", F.round(tempered_sigmoid(F.col("z"), F.lit(found)), 6).alias("tempered"), F.round(F.lit(found), 6).alias("temperature"))


#: Known and unseen frames; a class's boxes of a frame are matched among themselves.
_SPLIT = "CASE WHEN frame // 3 % 5 = 0 THEN 'val_unseen' ELSE 'val_known' END"
_BY_CLASS = "l_orderkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS frame"


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("frame", F.col("frame") * 3 + F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2))
    found = matching.match(rows.where("not is_slot"), rows.where("is_slot"), "frame", 0.5)
    split = F.when(F.floor(F.col("frame") / 3) % 5 == 0, "val_unseen").otherwise("val_known")
    named = found.withColumns({"split": split, "class": F.pmod("frame", F.lit(3)).cast("int")})
    predictions = named.where("predicted_id is not null").select("split", "class", F.col("predicted_score").alias("score"), F.col("truth_id").isNotNull().alias("hit"))
    truths = named.where("truth_id is not null").groupBy("split", "class").agg(F.count("*").alias("truths"))
    return running.average_precision(predictions, truths, ["split", "class"])


_AP = (
    matched_sql(at=0.5, truth_order="ASC").replace("l_orderkey AS frame", _BY_CLASS)
    + f"""
, s AS (SELECT {_SPLIT} AS split, CAST(frame % 3 AS INTEGER) AS class, predicted_score AS score, count(*) FILTER (truth_id IS NOT NULL) AS tp, count(*) FILTER (truth_id IS NULL) AS fp FROM m WHERE predicted_id IS NOT NULL GROUP BY ALL),
n AS (SELECT {_SPLIT} AS split, CAST(frame % 3 AS INTEGER) AS class, count(*) AS truths FROM m WHERE truth_id IS NOT NULL GROUP BY ALL),
pr AS (SELECT *, sum(tp) OVER o * 1.0 / (sum(tp) OVER o + sum(fp) OVER o) AS prec FROM s WINDOW o AS (PARTITION BY split, class ORDER BY score DESC)),
v AS (SELECT split, class, tp, max(prec) OVER (PARTITION BY split, class ORDER BY score) AS envelope FROM pr),
ap AS (SELECT n.split, n.class, truths, coalesce(sum(tp * envelope) / truths, 0) AS ap FROM n LEFT JOIN v ON v.split = n.split AND v.class = n.class GROUP BY n.split, n.class, truths)
"""
)


@_R.add("average_precision", _AP + "SELECT split, class, truths, round(ap, 6) AS ap FROM ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average precision at an overlap of one half, of each split and class."""
    return _curves(spark, sf_dir).withColumn("ap", F.round("ap", 6))


@_R.add("generalisation_gap", _AP + "SELECT round(avg(ap) FILTER (split = 'val_known'), 6) AS known, round(avg(ap) FILTER (split = 'val_unseen'), 6) AS unseen, round(avg(ap) FILTER (split = 'val_known') - avg(ap) FILTER (split = 'val_unseen'), 6) AS gap FROM ap")
def generalisation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over classes on known frames less that on unseen ones; null where a split has no truth."""
    mean = lambda split: F.avg(F.when(F.col("split") == split, F.col("ap")))
    means = _curves(spark, sf_dir).agg(mean("val_known").alias("known"), mean("val_unseen").alias("unseen"))
    return means.select(F.round("known", 6).alias("known"), F.round("unseen", 6).alias("unseen"), F.round(F.col("known") - F.col("unseen"), 6).alias("gap"))
