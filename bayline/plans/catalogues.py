"""Queries over source catalogues: documents are sources, their digest and hash identify content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions import hashing, text
from bayline.operators import dedupe, sampling
from bayline.operators.spool import written
from bayline.plans.registry import Registry
from bayline.sources.tables import table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
SEED = "20"


def _mod_sql(key: str, modulus: int) -> str:
    """SQL for hashing.score_mod()."""
    digest = f"sha256('{SEED}|' || CAST({key} AS VARCHAR))"
    out = "CAST(0 AS BIGINT)"
    for i in range(8):
        out = f"(({out}) * {16**8 % modulus} + CAST('0x' || substr({digest}, {1 + 8 * i}, 8) AS BIGINT)) % {modulus}"
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources: id, dataset, condition, size, digest, and the partition by hash."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("dataset"),
        F.col("lang").alias("condition"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("digest"),
        hashing.partition_70_15_15(F.col("doc_id"), SEED).alias("partition"),
    )


_M = _mod_sql("doc_id", 100)
SRC = f"""
WITH src AS (
  SELECT doc_id AS id, source AS dataset, lang AS condition, n_chars AS size, sha256(text) AS digest,
         CASE WHEN {_M} < 70 THEN 'train' WHEN {_M} < 85 THEN 'validation' ELSE 'test' END AS "partition"
  FROM documents)
"""


@_R.add("hash_split_70_15_15", SRC + 'SELECT id, "partition" FROM src')
def hash_split_70_15_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partition of each source."""
    return sources(spark, sf_dir).select("id", "partition")


@_R.add("known_holdout_split", f"SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'train' WHEN {_mod_sql('doc_id', 1000)} < 150 THEN 'val_known' ELSE 'train' END AS split FROM documents")
def known_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of one condition always train; 150 of 1000 of the rest validate."""
    held = hashing.score_mod(F.col("doc_id"), SEED, 1000) < 150
    split = F.when(F.col("lang") == "en", "train").when(held, "val_known").otherwise("train")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), split.alias("split"))


@_R.add(
    "partition_counts",
    SRC
    + """
SELECT "partition", count(*) AS samples, count(DISTINCT digest) AS contents, count(DISTINCT dataset) AS datasets, count(*) FILTER (WHERE condition = 'en') AS english FROM src GROUP BY 1
""",
)
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and distinct contents of each partition."""
    return sources(spark, sf_dir).groupBy("partition").agg(
        F.count("*").alias("samples"), F.count_distinct("digest").alias("contents"), F.count_distinct("dataset").alias("datasets"), F.count_if(F.col("condition") == "en").alias("english")
    )


@_R.add(
    "catalogue_summary",
    SRC + "SELECT dataset, count(*) AS scenarios, CAST(sum(size) AS BIGINT) AS total_size, array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions FROM src GROUP BY dataset",
)
def catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios, sizes and sorted conditions of each dataset."""
    conditions = F.array_join(F.sort_array(F.collect_set("condition")), ",")
    return sources(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("scenarios"), F.sum("size").alias("total_size"), conditions.alias("conditions"))


@_R.add(
    "catalogue_violations",
    SRC
    + """
SELECT dataset, 'too_few' AS violation, count(*) AS n FROM src GROUP BY dataset HAVING count(*) < 50
UNION ALL SELECT dataset, 'repeated_content', count(*) - count(DISTINCT digest) FROM src GROUP BY dataset HAVING count(*) > count(DISTINCT digest)
UNION ALL SELECT dataset, 'too_short', count(*) FROM src WHERE size < 100 GROUP BY dataset
""",
)
def catalogue_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a catalogue, one row for each dataset and rule; no row, no fault."""
    by = sources(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("contents"), F.count_if(F.col("size") < 100).alias("short"))
    rules = F.array(
        F.when(F.col("n") < 50, F.struct(F.lit("too_few").alias("violation"), F.col("n").alias("n"))),
        F.when(F.col("n") > F.col("contents"), F.struct(F.lit("repeated_content").alias("violation"), (F.col("n") - F.col("contents")).alias("n"))),
        F.when(F.col("short") > 0, F.struct(F.lit("too_short").alias("violation"), F.col("short").alias("n"))),
    )
    return by.select("dataset", F.inline(F.filter(rules, lambda r: r.isNotNull())))


@_R.add("leakage_keys", SRC + """SELECT digest, array_to_string(list_sort(list(DISTINCT "partition")), ',') AS partitions FROM src GROUP BY digest HAVING count(DISTINCT "partition") > 1""")
def leakage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that stand in several partitions."""
    return dedupe.leaking_keys(sources(spark, sf_dir), "digest", "partition").select("digest", F.array_join("partitions", ",").alias("partitions"))


@_R.add(
    "exposure_guard_anti",
    SRC
    + """
, exposed AS (SELECT * FROM src WHERE "partition" = 'test'),
hit AS (SELECT DISTINCT dataset, condition FROM src WHERE condition <> 'en' AND id % 50 = 3 AND digest IN (SELECT digest FROM exposed)),
own AS (SELECT * FROM src WHERE "partition" <> 'test')
SELECT o.id FROM own o WHERE o.digest NOT IN (SELECT digest FROM exposed)
  AND NOT EXISTS (SELECT 1 FROM own h JOIN exposed e ON h.digest = e.digest WHERE h.dataset = o.dataset AND h.condition = o.condition)
  AND NOT EXISTS (SELECT 1 FROM exposed e WHERE e.dataset = o.dataset AND e.condition = o.condition AND e.size > 30000)
""",
)
def exposure_guard_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources neither whose content nor whose group is exposed; only long exposed sources expose a group by name."""
    rows = sources(spark, sf_dir)
    test = rows.where("partition = 'test'")
    own = rows.where("partition <> 'test'")
    named = test.withColumn("dataset", F.when(F.col("size") > 30000, F.col("dataset")).otherwise("-"))
    return dedupe.exposure_guard(own, named, ["dataset", "condition"], "digest").select("id")


@_R.add(
    "duplicate_removal_v1",
    SRC
    + """
, r AS (SELECT *, CASE "partition" WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS rank FROM src)
SELECT id, "partition" FROM (SELECT *, min(rank) OVER (PARTITION BY digest) AS least FROM r) WHERE rank = least
""",
)
def duplicate_removal_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated content stays in the first of train, validation and test."""
    kept = dedupe.first_partition_wins(sources(spark, sf_dir), "digest", "partition", {"train": 0, "validation": 1, "test": 2})
    return kept.select("id", "partition")


@_R.add(
    "union_first_wins",
    SRC
    + """
, u AS (SELECT digest, id, 0 AS s FROM src WHERE "partition" = 'validation' UNION ALL SELECT digest, min(id), 1 FROM src GROUP BY digest),
v AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY s, id) AS n FROM u)
SELECT digest, s AS source FROM v WHERE n = 1
""",
)
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two relations; the first one's row stays where both have a key."""
    rows = sources(spark, sf_dir)
    first = rows.where("partition = 'validation'").select("digest", F.lit(0).alias("source"))
    second = rows.select("digest", F.lit(1).alias("source")).distinct()
    return dedupe.first_source_wins(first, second, key=["digest"])


def simhash_sql(relation: str, key: str, text: str) -> str:
    """CTEs that end in sim (id, hi, lo): the 64-bit SimHash of each row's whole text, in halves."""
    half = lambda at: " + ".join(f"CASE WHEN 2 * sum(CAST((h >> {at + i}) & 1 AS BIGINT)) > count(*) THEN {1 << i} ELSE 0 END" for i in range(32))
    return f"""
wd AS (SELECT {key} AS id, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS w FROM {relation}),
wh AS (SELECT id, CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) AS h FROM wd WHERE w <> ''),
sim AS (SELECT id, CAST({half(32)} AS BIGINT) AS hi, CAST({half(0)} AS BIGINT) AS lo FROM wh GROUP BY id)"""


NEAR = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"


def classes_sql(relation: str, key: str, text: str, most: int) -> str:
    """SQL for dedupe.hamming_classes() over the SimHash of whole texts."""
    return f"""WITH {simhash_sql(relation, key, text)},
least AS (SELECT hi, lo, min(id) AS a FROM sim GROUP BY ALL)
SELECT a, id AS b, CAST(0 AS INTEGER) AS distance FROM sim JOIN least USING (hi, lo) WHERE a < id
UNION ALL SELECT a.a, b.a, CAST({NEAR} AS INTEGER) FROM least a JOIN least b ON a.a < b.a WHERE {NEAR} <= {most}
"""


def with_hash(rows: DataFrame, text_column: str) -> DataFrame:
    """rows without the text, with digest and hash, the SimHash of their whole texts; null for those without a word. Written once, as every plan reads them several times."""
    return written(dedupe.with_simhash(rows, text_column))


@_R.add("hamming_band_pairs", classes_sql("pages", "page_id", "html", 3))
def hamming_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose 64-bit hashes differ in at most 3 bits: members of each class of equal hashes with its least id, and near classes."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    return dedupe.hamming_classes(with_hash(pages, "html"), "id", "hash", 3)


@_R.add(
    "quarantine_v2",
    SRC.replace("WITH src", "WITH " + simhash_sql("documents", "doc_id", "text") + ",\nsrc")
    + f"""
, s AS (SELECT src.id, "partition", digest, hi, lo, CASE "partition" WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS rank FROM src LEFT JOIN sim USING (id)),
near AS (SELECT a.id, b.id AS other, b.rank AS other_rank, b."partition" AS other_partition FROM s a JOIN s b ON b.rank < a.rank WHERE {NEAR} <= 3),
same AS (SELECT a.id, b.id AS other, b.rank AS other_rank, b."partition" AS other_partition FROM s a JOIN s b ON b.rank < a.rank AND a.digest = b.digest),
k1 AS (SELECT id FROM s WHERE rank = 1 AND id NOT IN (SELECT id FROM near UNION ALL SELECT id FROM same)),
kept AS (SELECT id FROM s WHERE rank = 0 UNION ALL SELECT id FROM k1 UNION ALL
  SELECT id FROM s WHERE rank = 2 AND id NOT IN (SELECT id FROM (SELECT * FROM near UNION ALL SELECT * FROM same) WHERE other_rank = 0 OR other IN (SELECT id FROM k1))),
x AS (SELECT id, max(other) AS conflict_id, any_value(other_partition) AS conflict_partition FROM same WHERE other IN (SELECT id FROM kept) GROUP BY id),
y AS (SELECT id, arg_min(other, (other_rank, other)) AS conflict_id, arg_min(other_partition, (other_rank, other)) AS conflict_partition FROM near WHERE other IN (SELECT id FROM kept) GROUP BY id)
SELECT s.id, "partition", s.id IN (SELECT id FROM kept) AS kept, coalesce(x.conflict_id, y.conflict_id) AS conflict_id, coalesce(x.conflict_partition, y.conflict_partition) AS conflict_partition
FROM s LEFT JOIN x ON x.id = s.id LEFT JOIN y ON y.id = s.id
""",
)
def quarantine_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source is kept when holdout goes before validation before training, and what it conflicts with."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = sources(spark, sf_dir).drop("digest").join(with_hash(texts, "text"), "id")
    found = dedupe.quarantine(rows, "id", "digest", "hash", "partition", ("test", "validation", "train"))
    return found.select("id", "partition", "kept", "conflict_id", "conflict_partition")


@_R.add(
    "camera_set_overlap",
    SRC
    + """
, d AS (SELECT dataset, bool_or("partition" = 'train') AS train, bool_or("partition" = 'validation') AS known, bool_or("partition" = 'test' AND size > 20000) AS unseen FROM src GROUP BY dataset)
SELECT 'train_and_unseen' AS rule, count(*) AS n FROM d WHERE train AND unseen UNION ALL SELECT 'known_not_train', count(*) FROM d WHERE known AND NOT train
""",
)
def camera_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras that stand in two sets, and known ones that training lacks."""
    rows = sources(spark, sf_dir)
    train, known = (rows.where(F.col("partition") == p).select("dataset") for p in ("train", "validation"))
    unseen = rows.where("partition = 'test' and size > 20000").select("dataset")
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    return count(train.intersect(unseen), "train_and_unseen").unionByName(count(known.subtract(train), "known_not_train"))


@_R.add("required_minus_present", "SELECT r_name AS missing FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 9900)")
def required_minus_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required names without a row."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9900").select("s_nationkey")
    present = table(spark, sf_dir, "nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    regions = table(spark, sf_dir, "region")
    return regions.join(present, regions.r_regionkey == present.n_regionkey, "left_anti").select(F.col("r_name").alias("missing"))


@_R.add(
    "bottom_k_per_partition",
    SRC + f"""SELECT id, "partition" FROM (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY sha256('{SEED}|' || CAST(id AS VARCHAR)), id DESC) AS n FROM src) WHERE n <= 20""",
)
def bottom_k_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sources of each partition by hash."""
    return sampling.bottom_k(sources(spark, sf_dir), ["partition"], "id", SEED, 20).select("id", "partition")


@_R.add(
    "balanced_selection",
    SRC + f"""SELECT id, dataset, english FROM (SELECT *, condition = 'en' AS english, row_number() OVER (PARTITION BY dataset, condition = 'en' ORDER BY sha256('{SEED}|' || CAST(id AS VARCHAR)), id DESC) AS n FROM src) WHERE n <= 5""",
)
def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources of each dataset and class."""
    rows = sources(spark, sf_dir).withColumn("english", F.col("condition") == "en")
    return sampling.balanced(rows, ["dataset"], "english", "id", SEED, 10).select("id", "dataset", "english")


@_R.add(
    "even_spacing",
    SRC
    + """
, r AS (SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY dataset) AS n FROM src),
m AS (SELECT i FROM range(0, 7) t(i))
SELECT DISTINCT r.id, r.dataset FROM r JOIN m ON r.n <= 7 OR r.k = CAST(round_even(m.i * (r.n - 1) / 6.0, 0) AS BIGINT)
""",
)
def even_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sources of each dataset at even spacing."""
    return sampling.even_spacing(sources(spark, sf_dir), ["dataset"], ["id"], 7).select("id", "dataset")


@_R.add("stride_sample", SRC + "SELECT id, dataset FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS k FROM src) WHERE k % 4 = 0 AND k < 40")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth source of a dataset, ten at most."""
    return sampling.stride(sources(spark, sf_dir), ["dataset"], ["id"], 4, 10).select("id", "dataset")


@_R.add(
    "diverse_subset",
    SRC
    + """
, b AS (SELECT *, row_number() OVER (PARTITION BY dataset, condition ORDER BY size DESC, id) AS own FROM src)
SELECT id, dataset, condition FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY size DESC, id) AS n FROM b WHERE own = 1) WHERE n <= 3
""",
)
def diverse_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest source of each condition, three of a dataset at most."""
    picked = sampling.distinct_lots(sources(spark, sf_dir), ["dataset"], "condition", [F.desc("size"), F.asc("id")], 3)
    return picked.select("id", "dataset", "condition")


@_R.add("slug_names", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from display names."""
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@_R.add("content_keys", "SELECT item_id, substr(sha256(text), 1, 24) AS long_key, substr(sha256(text), 1, 20) AS short_key FROM benchmark")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 24 and 20 digits from content."""
    return table(spark, sf_dir, "benchmark").select("item_id", hashing.content_key(F.col("text"), 24).alias("long_key"), hashing.content_key(F.col("text"), 20).alias("short_key"))


@_R.add(
    "label_quality_report",
    """
SELECT source AS dataset, count(*) AS images, count(quality) AS labelled, count(*) - count(quality) AS unlabelled,
       (count(*) - count(quality)) * 1.0 / count(*) > 0.65 AS quarantined
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""",
)
def label_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and unlabelled images; datasets with too many of the latter are set aside."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    missing = F.count("*") - F.count("quality")
    return joined.groupBy(F.col("source").alias("dataset")).agg(
        F.count("*").alias("images"), F.count("quality").alias("labelled"), missing.alias("unlabelled"), (missing / F.count("*") > 0.65).alias("quarantined")
    )


@_R.add(
    "run_accounting_unlabelled",
    """
WITH r AS (SELECT source, lang, n_chars % 97 AS part, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang, n_chars % 97)
SELECT count(*) AS runs, count(*) FILTER (WHERE labelled > 0) AS eligible, count(*) FILTER (WHERE labelled = 0) AS legacy,
       CAST(sum(n - labelled) FILTER (WHERE labelled > 0) AS BIGINT) AS excluded_predictions, count(*) FILTER (WHERE labelled < n AND labelled > 0) AS partial_runs FROM r
""",
)
def run_accounting_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that diagnostics can use, and predictions they leave out for want of a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") % 97).alias("part"))
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    runs = joined.groupBy("source", "lang", "part").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))
    some = F.col("labelled") > 0
    return runs.agg(
        F.count("*").alias("runs"), F.count_if(some).alias("eligible"), F.count_if(~some).alias("legacy"),
        F.sum(F.when(some, F.col("n") - F.col("labelled"))).alias("excluded_predictions"), F.count_if(some & (F.col("labelled") < F.col("n"))).alias("partial_runs"),
    )


@_R.add("retention_sweep", "SELECT doc_id FROM documents WHERE n_chars < 400 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files past their age that nothing refers to."""
    old = table(spark, sf_dir, "documents").where("n_chars < 400").select("doc_id")
    return old.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@_R.add(
    "logistic_score",
    """
WITH e AS (SELECT vec_id, label, list_sum([CAST(embedding[i + 1] AS DOUBLE) * (i % 5 - 2) FOR i IN range(len(embedding))]) AS z FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS probability FROM e
""",
)
def logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model on feature vectors, natively."""
    from bayline.functions.numbers import dot, sigmoid

    weights = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: (i % 5 - 2).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(sigmoid(dot(F.col("embedding"), weights)), 6).alias("probability"))


@_R.add(
    "softmax_class",
    """
WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings)
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS kind, round(1 / list_sum([exp(x - list_max(s)) FOR x IN s]), 6) AS probability FROM e
""",
)
def softmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest class, of as many as there are components."""
    from bayline.functions.numbers import argmax, softmax

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return rows.select("vec_id", argmax(F.col("s")).alias("kind"), F.round(F.array_max(softmax(F.col("s"))), 6).alias("probability"))
