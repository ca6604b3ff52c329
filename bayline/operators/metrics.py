"""Confusion counts and the metrics that follow from them, by any grouping."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.functions.numbers import calibration_bin, confidence, ratio_or_null, ratio_or_zero
from bayline.operators.spool import written

COUNTS = ("tp", "tn", "fp", "fn")


def confusion(predicted: Column, truth: Column) -> list[Column]:
    """The four counts of boolean predictions against boolean truth; rows without either do not count."""
    return [
        F.count_if(predicted & truth).alias("tp"),
        F.count_if(~predicted & ~truth).alias("tn"),
        F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"),
    ]


def nullable_metrics(counts: DataFrame, digits: int = 6) -> DataFrame:
    """counts with accuracy and the like; null where a denominator is zero.

    Balanced accuracy and F1 are taken from the rounded recall, specificity and precision.
    """
    c = {k: F.col(k) for k in COUNTS}
    rounded = lambda a, b: F.round(ratio_or_null(a, b), digits)
    out = counts.withColumns(
        {
            "accuracy": rounded(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]),
            "precision": rounded(c["tp"], c["tp"] + c["fp"]),
            "recall": rounded(c["tp"], c["tp"] + c["fn"]),
            "specificity": rounded(c["tn"], c["tn"] + c["fp"]),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns(
        {"balanced_accuracy": F.round((r + F.col("specificity")) / 2, digits), "f1": F.round(ratio_or_null(2 * p * r, p + r), digits)}
    )


def zero_metrics(counts: DataFrame, digits: int = 6) -> DataFrame:
    """counts with accuracy and the like; zero where a denominator is zero."""
    c = {k: F.col(k) for k in COUNTS}
    p, r = ratio_or_zero(c["tp"], c["tp"] + c["fp"]), ratio_or_zero(c["tp"], c["tp"] + c["fn"])
    s = ratio_or_zero(c["tn"], c["tn"] + c["fp"])
    all_rows = c["tp"] + c["tn"] + c["fp"] + c["fn"]
    return counts.withColumns(
        {
            "accuracy": F.round(ratio_or_zero(c["tp"] + c["tn"], all_rows), digits),
            "precision": F.round(p, digits),
            "recall": F.round(r, digits),
            "f1": F.round(ratio_or_zero(2 * p * r, p + r), digits),
            "specificity": F.round(s, digits),
            "balanced_accuracy": F.round((r + s) / 2, digits),
        }
    )


def probability_metrics(rows: DataFrame, groups: Sequence[str], p: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """Brier score and the rates of false verdicts; their denominators are at least one."""
    label, predicted = F.col(truth), F.col(p) >= threshold
    occupied, vacant = F.count_if(label), F.count_if(~label)
    return rows.groupBy(*groups).agg(
        F.round(F.avg(F.pow(F.col(p) - label.cast("double"), 2)), 6).alias("brier"),
        F.round(F.count_if(label & ~predicted) / F.greatest(occupied, F.lit(1)), 6).alias("false_vacant_rate"),
        F.round(F.count_if(~label & predicted) / F.greatest(vacant, F.lit(1)), 6).alias("false_occupied_rate"),
        F.count("*").alias("n"),
    )


def calibration_error(rows: DataFrame, groups: Sequence[str], p: str, truth: str, bins: int = 10, threshold: float = 0.5) -> DataFrame:
    """Expected calibration error over equal bins of confidence."""
    sure = confidence(F.col(p))
    right = ((F.col(p) >= threshold) == F.col(truth)).cast("double")
    by_bin = rows.groupBy(*groups, calibration_bin(sure, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(sure).alias("sure"), F.avg(right).alias("right")
    )
    return by_bin.groupBy(*groups).agg(
        F.round(F.sum(F.col("n") * F.abs(F.col("sure") - F.col("right"))) / F.sum("n"), 6).alias("calibration_error"), F.sum("n").alias("n")
    )


def order_statistics(rows: DataFrame, groups: Sequence[str], value: str, indices: Mapping[str, Callable[[Column], Column]], bins: int = 1024) -> DataFrame:
    """Elements of each group's sorted values by index, exactly: a column for each name in indices.

    indices maps a name to the index, from 0, as a function of the group's size. Equal values are
    one row with their number, written first, so that rows are read and values worked out once.
    They are counted in bins of equal width; only those of the bins that hold a wanted index are
    ranked, so no group is gathered or sorted as a whole. Nulls do not count.
    """
    keys = list(groups)
    known = written(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n")))
    size = known.groupBy(*keys).agg(F.sum("__n").alias("__size"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    wide = F.col("__high") - F.col("__low")
    share = F.try_divide(F.col("__v") - F.col("__low"), wide)
    together = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(F.broadcast(b)))  # without groups b has one row
    placed = together(known, size).withColumn("__bin", F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)))
    counts = placed.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__n"), F.first("__size").alias("__size"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__bin")) - F.col("__n")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), at(F.col("__size")).cast("long").alias("at")) for name, at in indices.items()))
    hit = F.filter(wanted, lambda w: (w["at"] >= F.col("__before")) & (w["at"] < F.col("__before") + F.col("__n")))
    chosen = counts.withColumn("__before", before).withColumn("__wanted", hit).where(F.size("__wanted") > 0).select(*keys, "__bin", "__before", "__wanted")
    values = placed.select(*keys, "__bin", "__v", "__n").join(chosen, [*keys, "__bin"])
    upto = F.sum("__n").over(W.partitionBy(*keys, "__bin").orderBy("__v")) + F.col("__before")
    ranked = values.withColumn("__upto", upto).select(*keys, "__v", "__n", "__upto", F.explode("__wanted").alias("__w"))
    found = ranked.where((F.col("__w.at") < F.col("__upto")) & (F.col("__w.at") >= F.col("__upto") - F.col("__n")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__w.name") == name, F.col("__v"))).alias(name) for name in indices))


def medians(rows: DataFrame, groups: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Each group's median, the mean of the middle two of an even number."""
    middle = {"__a": lambda n: F.floor((n - 1) / 2), "__b": lambda n: F.floor(n / 2)}
    found = order_statistics(rows, groups, value, middle)
    return found.select(*groups, ((F.col("__a") + F.col("__b")) / 2).alias(out))


def error_summary(predicted: Column, truth: Column, sure: Column, p: Column, threshold: float = 0.5) -> list[Column]:
    """Errors, sure ones (0.8 or more) and borderline ones (within 0.1 of the threshold)."""
    wrong = predicted != truth
    return [
        F.count_if(wrong).alias("errors"),
        F.count_if(wrong & (sure >= 0.8)).alias("sure_and_wrong"),
        F.count_if(wrong & (F.abs(p - threshold) <= 0.1)).alias("borderline_and_wrong"),
        F.count("*").alias("n"),
    ]
