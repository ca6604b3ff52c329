"""op6: byte-level BPE ids of every whole text and the text decoded from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.bpe import encode_documents


def op6_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text, for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_columns(encode_documents(docs))


def digest_columns(encoded: DataFrame) -> DataFrame:
    """The digests of encode_documents()."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_lexicon_bpe": op6_lexicon_bpe}
ORACLES: dict[str, str] = {}
