"""Row-level checks of a prepared catalogue: what is wrong, with which row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.functions import polygons
from bayline.operators.dedupe import near_hashes


def verify_catalogue(scenarios: DataFrame, slots: DataFrame, required: list[str], minimum: int) -> DataFrame:
    """(subject, reason): every violation of a catalogue; no row, no fault.

    scenarios: id, dataset, total, occupied, digest, hash; slots: id, occupied, pairs. Of equal
    digests all but the least id are duplicates, as are rows whose hash is within one bit of that
    of a lesser id. Required datasets must be there, each dataset with minimum scenarios.
    """
    bad = polygons.validity(F.col("pairs"))
    found = slots.groupBy("id").agg(F.count("*").alias("slots"), F.count_if("occupied").alias("taken"), F.count_if(bad.isNotNull()).alias("invalid"))
    joined = scenarios.join(found, "id", "left")
    tests = {
        "no_slots": F.col("slots").isNull(),
        "slot_total_mismatch": F.col("slots") != F.col("total"),
        "occupied_total_mismatch": F.col("taken") != F.col("occupied"),
        "missing_source_hash": F.coalesce(F.length("digest"), F.lit(0)) != 64,
        "missing_perceptual_hash": F.coalesce(F.length("hash"), F.lit(0)) != 16,
        "invalid_polygon": F.col("invalid") > 0,
    }
    named = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda r: r.isNotNull())
    subject = F.col("id").cast("string").alias("subject")
    of_rows = joined.select(subject, F.explode(named).alias("reason"))
    first = scenarios.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"))
    exact = scenarios.join(first, "digest").where(F.col("id") > F.col("first")).select(subject, F.lit("exact_duplicate").alias("reason"))
    least = scenarios.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min("id").alias("least"))
    near = near_hashes(least, "hash", 1)
    beside = near.select(F.inline(F.array(*(F.struct(F.col(a).alias("hash"), F.col(b).alias("other")) for a, b in (("x", "y"), ("y", "x"))))))
    other = beside.join(least.select(F.col("hash").alias("other"), F.col("least").alias("of_other")), "other").groupBy("hash").agg(F.min("of_other").alias("of_other"))
    reach = least.join(other, "hash", "left").select("hash", F.least("least", "of_other").alias("first"))
    close = scenarios.join(reach, "hash").where(F.col("id") > F.col("first")).select(subject, F.lit("near_duplicate").alias("reason"))
    counts = scenarios.groupBy("dataset").agg(F.count("*").alias("n"))
    wanted = scenarios.sparkSession.createDataFrame([(d,) for d in required], "dataset string")
    absent = wanted.join(counts, "dataset", "left_anti").select(F.col("dataset").alias("subject"), F.lit("missing_dataset").alias("reason"))
    few = counts.where(F.col("n") < minimum).select(F.col("dataset").alias("subject"), F.lit("below_minimum").alias("reason"))
    return of_rows.unionByName(exact).unionByName(close).unionByName(absent).unionByName(few)
