"""op5: the quality score of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.linear import crc_of
from bayline.llm.rules import learn_quality, score_quality


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules learned from two thirds of the labelled rows, scores for all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_of("doc_id") % 3 == 1
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
