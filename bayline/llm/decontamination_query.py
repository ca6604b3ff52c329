"""op13: what documents share with the items of benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.decontamination import contamination


def op13_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        F.col("contamination.n_hit").alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op13_window_decontamination": op13_window_decontamination}
ORACLES = {
    "op13_window_decontamination": r"""
WITH
words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS g
  FROM items WHERE len(w) > 0),
runs AS (
  SELECT row, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g
  FROM words, (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k),
hits AS (SELECT row, runs.k, i, item FROM runs JOIN wanted ON wanted.k = runs.k AND wanted.g = runs.g),
hit AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + k)) AS place FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
}
