"""Versioned model parameters as a table that is checked before anything is scored with it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions.numbers import sigmoid

SCHEMA_VERSION = 1


def parameter_digest(entries: Column) -> Column:
    """The SHA-256 of (name, value) entries in order of their names, values by their bits."""
    text = F.transform(F.array_sort(entries), lambda e: F.concat_ws("=", e["name"], F.xxhash64(e["value"]).cast("string")))
    return F.sha2(F.array_join(text, ";"), 256)


def parameter_rows(spark: SparkSession, version: str, weights: Mapping[str, float]) -> DataFrame:
    """The rows of one version: schema_version, version, name, value and the digest of all its values."""
    rows = spark.createDataFrame([(SCHEMA_VERSION, version, n, float(v)) for n, v in weights.items()], "schema_version int, version string, name string, value double")
    digest = rows.groupBy("version").agg(parameter_digest(F.collect_list(F.struct("name", "value"))).alias("digest"))
    return rows.join(digest, "version").select("schema_version", "version", "name", "value", "digest")


def gated(table: DataFrame, names: list[str]) -> DataFrame:
    """(version, weights, reason): each version's weights as a map, or null with the first gate that it fails.

    Gates, in order: the schema's version, exactly the names wanted, finite values, the digest. One
    bad row refuses the whole version.
    """
    entries = F.collect_list(F.struct("name", "value"))
    versions = table.groupBy("version").agg(
        F.bool_and(F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False))).alias("schema"),
        F.bool_and(F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))).alias("finite"),
        F.sort_array(F.collect_list("name")).alias("names"),
        F.count_distinct("digest").alias("digests"), F.first("digest").alias("digest"),
        parameter_digest(entries).alias("own"), entries.alias("entries"),
    )
    reason = (
        F.when(~F.col("schema"), "wrong_schema")
        .when(F.col("names") != F.array(*map(F.lit, sorted(names))), "wrong_names")
        .when(~F.col("finite"), "not_finite")
        .when((F.col("digests") != 1) | (F.col("digest") != F.col("own")), "wrong_digest")
    )
    weights = F.when(F.col("reason").isNull(), F.map_from_entries("entries"))
    return versions.withColumn("reason", reason).select("version", weights.alias("weights"), "reason")


def scored(rows: DataFrame, table: DataFrame, features: list[str], intercept: str = "intercept") -> DataFrame:
    """rows, which name a version, with the logistic score under it; null where the version is unknown or refused."""
    fine = gated(table, [intercept, *features]).where("reason is null").select("version", "weights")
    margin = sum((F.col("weights")[f] * F.col(f) for f in features), F.col("weights")[intercept])
    return rows.join(fine, "version", "left").withColumn("score", sigmoid(margin)).drop("weights")
