"""op12: documents drawn towards the distribution of benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayline.llm.importance import resampled


def op12_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


QUERIES = {"op12_prefix_crc_resampling": op12_prefix_crc_resampling}
ORACLES = {
    "op12_prefix_crc_resampling": r"""
WITH
steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
words AS (
  SELECT side, id, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, row, unnest(w) AS w1, unnest(w[2:]) AS w2 FROM words),
features AS (SELECT side, row, w1 AS f FROM runs UNION ALL SELECT side, row, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
buckets AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(('0x' || h[2 * i + 1:2 * i + 2]) AS BIGINT) FOR i IN range(len(h) // 2)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM bytes, steps),
hashed AS (SELECT side, row, bucket FROM features JOIN buckets USING (f)),
totals AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM hashed),
gains AS (
  SELECT bucket, floor(1000 * ln((t1 + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((s1 + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS gain
  FROM (SELECT bucket, count(*) FILTER (side = 0) AS s1, count(*) FILTER (side = 1) AS t1 FROM hashed GROUP BY bucket), totals),
sums AS (SELECT row, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM hashed JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN sums USING (row) WHERE side = 0),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features) END AS place,
    count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM ranked
"""
}
