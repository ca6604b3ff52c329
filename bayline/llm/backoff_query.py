"""op9: log-probabilities of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayline.llm.backoff import score_texts
from bayline.llm.linear import crc_of


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of all texts under a model of nine tenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, crc_of("doc_id") % 10 != 0)


QUERIES = {"op9_backoff_scores": op9_backoff_scores}
ORACLES: dict[str, str] = {}
