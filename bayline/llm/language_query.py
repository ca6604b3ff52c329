"""op8: the language of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayline.llm.language import fit_languages, predict_languages
from bayline.llm.linear import crc_of


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from three quarters of the rows, predicted for all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_of("doc_id") % 4 == 2
    model = fit_languages(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op8_language_codes": op8_language_codes}
ORACLES: dict[str, str] = {}
