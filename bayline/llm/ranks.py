"""Gapless ranks inside groups of any size, no group in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.llm.store import materialise


#: Buckets that a hot group is dealt over; a fixed number, so that ranks hang on the data alone.
BUCKETS = 1 << 16


def leading_bucket(digest: Column) -> Column:
    """The bucket of a digest in binary: its first 16 bits, so buckets in order are digests in order."""
    return F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int")


def row_bucket(*columns: str) -> Column:
    """A bucket for each row by what the columns hold. Equal rows share one."""
    return F.xxhash64(*columns).bitwiseAND(BUCKETS - 1).cast("int")


def gapless_rank(df: DataFrame, group: str, bucket: str, order: list[str], name: str) -> DataFrame:
    """df with name = 0, 1, 2, ... inside each group, by bucket and then by order.

    df must be a written table that holds the bucket column. Rows are ranked inside
    (group, bucket); the counts of the buckets, one row for each, give each bucket's offset.
    """
    counts = df.groupBy(group, bucket).agg(F.count("*").alias("__n"))
    before = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inner = W.partitionBy(group, bucket).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(inner) - 1)
        .join(offsets, [group, bucket])
        .withColumn(name, (F.col("__rank") + F.col("__offset")).cast("long"))
        .drop("__rank", "__offset")
    )


def range_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name = 1, 2, 3, ... over all rows in an order.

    Rows are dealt to tasks by ranges of the order and sorted there; the driver sees one count for
    each range.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    offsets, total = [], 0
    for number, n in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((number, total - (number << 33) + 1))
        total += n
    offsets = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    placed = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row for each range
    return placed.withColumn(name, F.col("__at") + F.col("__offset")).drop("__at", "__part", "__offset")
