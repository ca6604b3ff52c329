"""op3: documents mixed to target shares of good, poor and toxic tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.llm.mixing import label_domains, mix

#: Shares of all tokens; toxic ones are rare enough for some rates to stand at zero.
TARGETS = {"good": 0.95, "poor": 0.048, "toxic": 0.002}


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, posteriors, rate and copies of each row of documents, and how the fit ended.

    fit_error is the largest miss of a target as a share of all tokens, fit_steps how many steps
    were taken, fit_met whether the targets are met.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labelled = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed, model, fit = mix(docs, labelled, TARGETS)
    share = {d: F.col("posterior")[i] for i, d in enumerate(model.domains)}
    return mixed.select("doc_id", "n_tokens", *(share.get(d, F.lit(0.0)).alias(f"p_{d}") for d in TARGETS), "rate", "copies", F.lit(fit.error).alias("fit_error"), F.lit(len(fit.steps)).alias("fit_steps"), F.lit(fit.converged).alias("fit_met"))


QUERIES = {"op3_soft_mixing": op3_soft_mixing}
ORACLES: dict[str, str] = {}
