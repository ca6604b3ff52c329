"""Choosing parameters over grids: every grid point is a group of one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.functions.numbers import grid, ratio_or_zero


def by_threshold(rows: DataFrame, groups: list[str], p: str, truth: str, low: float, step: float, n: int) -> DataFrame:
    """Confusion counts at each of n thresholds, for each group.

    Rows are first counted by the number of thresholds they pass, which is arithmetic on p rounded
    to 9 digits, so the grid multiplies a small histogram and not the rows.
    """
    points = grid(low, step, n)
    beyond = F.floor((F.round(F.col(p), 9) + 5e-10 - low) / step) + 1
    passed = F.least(F.greatest(beyond, F.lit(0)), F.lit(n))
    counted = rows.groupBy(*groups, passed.alias("passed")).agg(F.count_if(F.col(truth)).alias("yes"), F.count_if(~F.col(truth)).alias("no"))
    spread = counted.select(*groups, "passed", "yes", "no", F.posexplode(points).alias("i", "threshold"))
    hit = F.col("passed") > F.col("i")
    total = lambda c: F.sum(c).cast("long")
    return spread.groupBy(*groups, "i", "threshold").agg(
        total(F.when(hit, F.col("yes")).otherwise(0)).alias("tp"), total(F.when(hit, 0).otherwise(F.col("no"))).alias("tn"),
        total(F.when(hit, F.col("no")).otherwise(0)).alias("fp"), total(F.when(hit, 0).otherwise(F.col("yes"))).alias("fn"),
    )


def balanced_accuracy() -> Column:
    """Mean of recall and specificity of the counts tp, tn, fp and fn; zero without a denominator."""
    recall = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = ratio_or_zero(F.col("tn"), F.col("tn") + F.col("fp"))
    return (recall + specificity) / 2


def best(rows: DataFrame, objective: list[Column], keep: list[str], groups: list[str] | None = None) -> DataFrame:
    """The row of the largest objective, compared element by element; the objective decides all ties."""
    order = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(objective)))
    picked = F.max_by(F.struct(*keep), order).alias("b")
    grouped = rows.groupBy(*groups).agg(picked) if groups else rows.agg(picked)
    return grouped.select(*(groups or []), "b.*")
