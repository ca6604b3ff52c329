"""Deterministic samples: by hash, at even spacing, by stride, balanced, diverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.functions.hashing import score
from bayline.operators.ranks import with_places


def bottom_k(rows: DataFrame, groups: list[str], key: str, seed: str | int, k: int) -> DataFrame:
    """The k rows of each group with the least hash of seed|key; the larger key among equals."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(score(F.col(key), seed), F.desc(key)))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def balanced(rows: DataFrame, groups: list[str], label: str, key: str, seed: str | int, most: int) -> DataFrame:
    """Half of most rows for each label of a group, by hash."""
    return bottom_k(rows, [*groups, label], key, seed, most // 2)


def even_spacing(rows: DataFrame, groups: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group at even spacing from first to last, halves rounded to even; all if fewer.

    The first column of order is a number or a time.
    """
    marks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__size") - 1) / F.lit(float(max(n - 1, 1))), 0).cast("long"))
    ranked = with_places(rows, groups, order, "__place", "__size")
    return ranked.where((F.col("__size") <= n) | F.array_contains(marks, F.col("__place"))).drop("__place", "__size")


def stride(rows: DataFrame, groups: list[str], order: list[str], step: int, share: int) -> DataFrame:
    """Every step-th row of each group, share rows at most. The first column of order is a number or a time."""
    ranked = with_places(rows, groups, order, "__place", "__size")
    return ranked.where((F.col("__place") % step == 0) & (F.col("__place") < step * share)).drop("__place", "__size")


def spread_positions(n: Column, k: int) -> Column:
    """Midpoints of k equal spans of n positions, as whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(n * (i + 0.5) / k))


def distinct_lots(rows: DataFrame, groups: list[str], lot: str, order: list[Column], most: int) -> DataFrame:
    """The best row of each lot, most lots of each group, by order."""
    own = F.row_number().over(W.partitionBy(*groups, lot).orderBy(*order))
    best = rows.withColumn("__own", own).where("__own = 1").drop("__own")
    return best.withColumn("__n", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def condition_first(rows: DataFrame, layout: str, condition: str, key: str, seed: str | int, n: int) -> DataFrame:
    """n rows of each layout: first the one of least hash of each condition, by condition, then the rest by hash."""
    hashed = rows.withColumn("__score", score(F.col(key), seed))
    own = F.row_number().over(W.partitionBy(layout, condition).orderBy("__score", key))
    lead = F.when(F.col("__own") == 1, F.col(condition))
    order = W.partitionBy(layout).orderBy(lead.isNull(), lead, "__score", key)
    ranked = hashed.withColumn("__own", own).where(F.col("__own") <= n + 1).withColumn("__n", F.row_number().over(order))
    return ranked.where(F.col("__n") <= n).drop("__score", "__own", "__n")


def diverse(rows: DataFrame, group: str, condition: str, lot: str, key: str, n: int) -> DataFrame:
    """n rows of each group with their place, of which each is the one that a single order puts first.

    The order is over the rows that are left: rows of a condition that nobody chosen has, by
    condition and then those of a lot without a choice; then rows of a lot that nobody chosen has,
    by lot; then by the choices of their lot and those of their condition; at the end by key. Only
    the first n rows of a condition and lot can come first, so a group's array holds no more.
    """
    rank = F.row_number().over(W.partitionBy(group, condition, lot).orderBy(key))
    entry = F.struct(F.col(condition).alias("c"), F.col(lot).alias("l"), F.col(key).alias("k"))
    few = rows.withColumn("__n", rank).where(F.col("__n") <= n).groupBy(group).agg(F.collect_list(entry).alias("rows"))

    def standing(row: Column, taken: Column) -> Column:
        same = lambda name: F.size(F.filter(taken, lambda t: t[name].eqNullSafe(row[name])))
        of_condition, of_lot, none = same("c"), same("l"), F.lit(0)
        new_condition, new_lot = of_condition == 0, of_lot == 0
        return F.struct(
            F.when(new_condition, 0).when(new_lot, 1).otherwise(2).alias("rule"),
            F.when(new_condition, row["c"]).alias("condition"),
            F.when(new_condition, F.least(of_lot, F.lit(1))).otherwise(none).alias("used"),
            F.when(~new_condition & new_lot, row["l"]).alias("lot"),
            F.when(new_condition | new_lot, none).otherwise(of_lot).alias("lots"),
            F.when(new_condition | new_lot, none).otherwise(of_condition).alias("conditions"),
            row["k"].alias("k"),
            row.alias("row"),
        )

    def add(taken: Column, _: Column) -> Column:
        left = F.array_except(F.col("rows"), taken)
        first = F.array_min(F.transform(left, lambda row: standing(row, taken)))
        return F.when(first.isNull(), taken).otherwise(F.concat(taken, F.array(first["row"])))

    kind = few.schema["rows"].dataType.simpleString()
    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast(kind), add)
    out = few.select(group, F.posexplode(chosen).alias("p", "r"))
    return out.select(group, F.col("r.c").alias(condition), F.col("r.l").alias(lot), F.col("r.k").alias(key), (F.col("p") + 1).alias("place"))
