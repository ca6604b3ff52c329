"""op11: the collocations of each language of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayline.llm.collocations import collocations


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to four words of each language by their score."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


QUERIES = {"op11_setm_collocations": op11_setm_collocations}
ORACLES = {
    "op11_setm_collocations": r"""
WITH
pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang HAVING sum(len(w)) > 0),
runs AS (SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3, unnest(w[4:]) AS w4 FROM words),
f AS (
  SELECT lang, 1 AS k, w1 AS g, count(*) AS a FROM runs GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
cuts AS (SELECT lang, k, g, string_split(g, ' ') AS w, a, c FROM f, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scored AS (
  SELECT cuts.*, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * cuts.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cuts.lang AND y.g = array_to_string(w[c + 1:cuts.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT lang, g, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(string_split(g, ' ')[i:i + j - 1], ' ') FOR i IN range(1, k - j + 2)]) AS g FROM f, (SELECT unnest([2, 3]) AS j) WHERE k > j) GROUP BY lang, g),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside i ON i.lang = lowest.lang AND i.g = lowest.g
  WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * lowest.a),
ranked AS (
  SELECT lang, g AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
}
