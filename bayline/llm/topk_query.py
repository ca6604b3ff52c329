"""op4: the ten best inner products of every hundredth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.topk import integer_vectors, top_k


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 of each query over the whole table."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


QUERIES = {"op4_threshold_topk": op4_threshold_topk}
ORACLES = {
    "op4_threshold_topk": """
WITH v AS (
  SELECT vec_id, unnest([CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS x,
         unnest(range(len(embedding))) AS i
  FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
