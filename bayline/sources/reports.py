"""Writers of reports and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.functions import polygons

#: The columns of the run report, in order.
REPORT_COLUMNS = [
    "id", "dataset", "scenario_id", "total_spaces", "occupied_spaces", "vacant_spaces", "occupancy_rate",
    "average_confidence", "ground_truth_agreement", "processing_time_ms", "model_name", "created_at",
]


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lines; the commit protocol makes the folder appear whole or not at all."""
    rows.write.mode("overwrite").json(path)


def write_json_report(row: DataFrame, path: str) -> None:
    """Write a one-row relation as one JSON document, its nulls included."""
    row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_run_csv(runs: DataFrame, path: str) -> None:
    """Write the report columns; further columns of runs are left out, missing ones stay empty."""
    columns = [F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS]
    runs.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_label_lines(slots: DataFrame, path: str, style: str = "obb") -> DataFrame:
    """Write label files by split; returns how many slots each split kept and skipped.

    slots: split, image, kind, pairs. Slots whose quad is not acceptable are skipped.
    """
    marked = slots.withColumn("ok", F.coalesce(polygons.acceptable_quad(F.col("pairs")), F.lit(False)))
    line = label_text(F.col("kind"), polygons.canonical(polygons.from_pairs(F.col("pairs"))), style)
    lines = marked.where("ok").select("split", "image", line.alias("line")).groupBy("split", "image").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy("split", "image").text(path)
    return marked.groupBy("split").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("skipped"))


def label_text(kind: Column, quad: Column, style: str) -> Column:
    """A label line: obb and seg give the corners, pose the box around them and then the corners, each marked visible."""
    digits = lambda v: F.format_string("%.6f", v)
    numbers = F.flatten(F.transform(quad, lambda p: F.array(digits(p.x), digits(p.y))))
    if style == "pose":
        b = polygons.bounds(quad)
        around = F.array(*(digits(v) for v in ((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1)))
        seen = F.transform(quad, lambda p: F.array(digits(p.x), digits(p.y), digits(F.lit(2.0))))
        numbers = F.concat(around, F.flatten(seen))
    return F.concat_ws(" ", kind.cast("string"), F.array_join(numbers, " "))


def additive(*relations: DataFrame) -> DataFrame:
    """Relations of growing schemas as one; columns that a relation lacks are null."""
    out = relations[0]
    for r in relations[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
