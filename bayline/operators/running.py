"""Running sums and maxima over an order, range by range, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.operators.spool import written

PART = "__part"


def in_ranges(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """rows dealt to ranges of (groups, order), which PART numbers in that order, written for what follows.

    A group of any size is cut into as many ranges as it needs, so no task sorts a whole one.
    """
    return written(rows.repartitionByRange(*(F.col(g) for g in groups), *order).withColumn(PART, F.spark_partition_id()))


def running_sums(ranged: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """ranged, of in_ranges(), with the sum of each column, by its new name, up to and with the row in its group.

    Sums inside a range start from those of the group's ranges before, one row for each.
    """
    totals = ranged.groupBy(*groups, PART).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = W.partitionBy(*groups).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, PART, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    own = W.partitionBy(*groups, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ranged.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(offsets, [*groups, PART])
    return summed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*(f"__{n}" for n in sums))


def maxima_ahead(ranged: DataFrame, groups: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    """ranged with the greatest value of column in the row and all that follow it in its group."""
    totals = ranged.groupBy(*groups, PART).agg(F.max(column).alias("__top"))
    after = W.partitionBy(*groups).orderBy(PART).rowsBetween(1, W.unboundedFollowing)
    tops = totals.select(*groups, PART, F.max("__top").over(after).alias("__top"))
    own = W.partitionBy(*groups, PART).orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return ranged.withColumn(name, F.max(column).over(own)).join(tops, [*groups, PART]).withColumn(name, F.greatest(name, "__top")).drop("__top")


def average_precision(predictions: DataFrame, truths: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, truths, ap): the area under the envelope of precision over recall, of each group that has truths.

    predictions are (groups, score, hit), where hit tells that a truth of its own was matched;
    truths are (groups, truths), their number. Predictions of one score count at once, so the result
    does not hang on their order; one without a score goes last. The envelope is the greatest
    precision at any later threshold. A group without a hit has 0.
    """
    by_score = predictions.groupBy(*groups, F.coalesce("score", F.lit(float("-inf"))).alias("score")).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    order = [F.desc("score")]
    summed = running_sums(in_ranges(by_score, groups, order), groups, order, {"all_tp": "tp", "all_fp": "fp"})
    curve = summed.select(*groups, PART, "score", "tp", (F.col("all_tp") / (F.col("all_tp") + F.col("all_fp"))).alias("precision"))
    area = maxima_ahead(curve, groups, order, "precision", "envelope").groupBy(*groups).agg(F.sum(F.col("tp") * F.col("envelope")).alias("__area"))
    known = truths.where("truths > 0").join(area, groups, "left")
    return known.select(*groups, "truths", F.coalesce(F.col("__area") / F.col("truths"), F.lit(0.0)).alias("ap"))
