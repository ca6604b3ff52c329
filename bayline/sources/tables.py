"""Readers for the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor folder; Spark prunes its columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
