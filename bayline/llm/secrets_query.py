"""op7: the secrets of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.secrets import BASE_KINDS, scan_secrets


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of secret spans, one row for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", F.col("secret_spans").alias("s"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ","
    )
    base = F.filter("s", lambda x: x.kind.isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("s", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict[str, str] = {}
