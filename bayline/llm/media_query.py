"""op1: every whole text as chunked, deduplicated and verified media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayline.llm.media import media_columns


def op1_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, digests and features read back from the chunk store, for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return media_columns(docs).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


QUERIES = {"op1_chunked_media": op1_chunked_media}
ORACLES: dict[str, str] = {}
