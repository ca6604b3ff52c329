"""Camera recognition and the choice of a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.functions.hashing import hamming_hex64
from bayline.functions.verdicts import layout_state
from bayline.operators.dedupe import hashes_near

MATCH_BITS, PREFILTER_BITS, INLIERS, ASPECT, AGREEMENT = 12, 40, 0.30, 0.12, 0.35


def recognise(images: DataFrame, layouts: DataFrame, inliers: DataFrame | None = None) -> DataFrame:
    """Each image's first verified layout of the same camera, by layout order.

    images: image_id, fingerprint, width, height; layouts: layout_id, fingerprint, width, height.
    The pictures' shapes must agree; then the fingerprints must be near, or, where inliers
    (image_id, layout_id, ratio) has measured it, fairly near with enough matching structure.
    Layouts are the small side by their nature (one for each camera), but no broadcast is asked
    for: the shape, in steps, is the join key, so both sides are hashed.
    """
    step = lambda w, h: F.floor(F.ln(w / F.greatest(h, F.lit(1))) / 0.25)
    i = images.select("image_id", F.col("fingerprint").alias("f"), (F.col("width") / F.greatest("height", F.lit(1))).alias("aspect"), step(F.col("width"), F.col("height")).alias("step"))
    stored = F.col("width") / F.greatest("height", F.lit(1))
    own = step(F.col("width"), F.col("height"))
    near_steps = F.explode(F.array(own - 1, own, own + 1)).alias("step")
    j = layouts.select("layout_id", F.col("fingerprint").alias("g"), stored.alias("stored"), near_steps)
    both = i.join(j, "step").where(F.abs(F.col("aspect") - F.col("stored")) <= ASPECT * F.greatest("stored", F.lit(1.0)))
    both = both.withColumn("bits", hamming_hex64(F.col("f"), F.col("g")))
    match = F.col("bits") <= MATCH_BITS
    if inliers is not None:
        both = both.join(inliers, ["image_id", "layout_id"], "left")
        match = match | ((F.col("bits") <= PREFILTER_BITS) & (F.coalesce("ratio", F.lit(0.0)) >= INLIERS))
    return both.where(match).groupBy("image_id").agg(F.min("layout_id").alias("layout_id"))


def choose_layout(scenes: DataFrame) -> DataFrame:
    """scenes with state and whether it is usable; see layout_state() for the columns it takes."""
    state = layout_state(*(F.col(c) for c in ("agreement", "recalled", "detected", "confidence", "verified", "detector")))
    corroborated = F.col("verified") | ((F.col("recalled") > 0) & (~F.col("detector") | (F.col("agreement") >= AGREEMENT)))
    slots = F.when(corroborated, F.greatest("recalled", "detected")).otherwise(F.col("detected"))
    usable = F.col("state").isin("reused_verified", "auto_detected", "verification_required") & (slots > 0)
    return scenes.withColumn("state", state).withColumn("usable", usable)


def known_hash(rows: DataFrame, known: DataFrame, digest: str, hashed: str, most: int = 3) -> DataFrame:
    """rows neither whose digest is known nor whose hash is within most bits of a known one; distinct hashes meet, never rows."""
    return rows.join(known.select(digest).distinct(), digest, "left_anti").join(hashes_near(rows, known, hashed, most), hashed, "left_anti")


def new_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests for media that have no queued or running job, one for each medium."""
    active = jobs.where(F.col("status").isin("queued", "running")).select("media_asset_id")
    first = F.row_number().over(W.partitionBy("media_asset_id").orderBy("id"))
    return requests.join(active, "media_asset_id", "left_anti").withColumn("n", first).where("n = 1").drop("n")


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with those that a restart cut off marked as interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def readiness(*checks: DataFrame) -> DataFrame:
    """Checks (name, ready) as one relation with how many are ready."""
    union = checks[0]
    for c in checks[1:]:
        union = union.unionByName(c)
    return union.agg(F.count_if("ready").alias("ready"), F.count("*").alias("checks"), F.bool_and("ready").alias("all_ready"))
