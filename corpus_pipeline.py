"""A corpus pipeline: quality, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and gives the columns of documents on, the last one apart.
Stages work on whatever rows come in: rows with null texts, repeated rows, and empty tables pass
as their operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.bpe import encode_documents
from bayline.llm.jaccard import Similarity, similar_components
from bayline.llm.mixing import label_domains, mix, thinned
from bayline.llm.rules import learn_quality, score_quality
from bayline.llm.secrets import redact_secrets
from bayline.llm.store import materialise

#: Share of their tokens that likely toxic documents keep; the others keep all of theirs.
TOXIC_SHARE = 0.01


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return score_quality(docs, model, "__score").where("__score >= 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of four fifths common 5-word shingles.

    Rows are known by a 64-bit hash of doc_id and text, so each text of a repeated doc_id has its
    own component; of one doc_id's texts in a component that of the least hash stays. Documents
    without words are linked with nothing and stay, as do rows without a doc_id, which no component
    can be named by.
    """
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = materialise(similar_components(rows, Similarity(5, 80, 100), "__row").where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id").distinct())
    named = rows.where("doc_id is not null").select("doc_id", "__row").join(found, "__row")
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.__row")
    worded = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    first = rows.where(worded & F.col("doc_id").isNotNull()).join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(docs.columns)
    empty = docs.where(~worded & F.col("doc_id").isNotNull())
    return first.unionByName(empty).unionByName(docs.where("doc_id is null")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by its kind."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their rates, none more than once.

    The targets are what each domain would have if likely toxic documents kept TOXIC_SHARE of
    their tokens, which rates up to one can meet.
    """
    labelled = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed, _, _ = mix(docs, labelled, thinned("toxic", TOXIC_SHARE), max_rate=1.0)
    return mixed.where("copies > 0").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    encoded = encode_documents(docs)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Trained models decide two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
