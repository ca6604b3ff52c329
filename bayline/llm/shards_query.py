"""op2: all documents on eight shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.shards import schedule


def op2_longest_first_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of documents under the law of bytes."""
    placed = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op2_longest_first_shards": op2_longest_first_shards}
ORACLES: dict[str, str] = {}
