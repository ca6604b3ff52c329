"""Longest-processing-time scheduling of row groups onto shards.

Rows with equal texts form a group that stays together. Groups go, largest first, to the shard
with the least bytes so far. Sizes are dealt in classes: below EXACT each size is a class of its
own, above it sizes that share their first PRECISION bits are, so the driver sees at most
EXACT + 52 * 2 ** (PRECISION - 1) classes (about 110,000), however many groups there are. Inside
a class, groups count as equal, and the heap's choices for all of them are found at once.

A null text is a group of its own beside the empty text; both have size 1 for each row. Rows
with a null or repeated doc_id are rows like any other. Groups of a class go in order of their
text's digest, and of shards with equal loads the first by number gets the next group (ties), so
shards and slots are functions of the rows: no setting of the session changes them. A
very long text is one row of its size. Columns other than doc_id and text are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm.hot import join_one
from bayline.llm.ranks import gapless_rank, leading_bucket, row_bucket
from bayline.llm.store import materialise

PRECISION = 12
EXACT = 1 << PRECISION


def deal_class(loads: list[float], size: float, n: int) -> list[int]:
    """How many of n items of one size each shard gets when each goes to the least loaded.

    Adds their bytes to loads. Full rounds, in which every shard gets one, are dealt at once when
    the loads lie within one item of each other; the heap deals the rest.
    """
    shards = len(loads)
    given = [0] * shards
    level = max(loads)
    # below the fullest shard: all items that start under its load go there in any order
    room = [max(0, int((level - load) // size)) for load in loads]
    if sum(room) <= n:
        given = room
    else:  # the items end before the level: find how high they fill
        low, high = 0, level
        for _ in range(80):
            middle = (low + high) / 2
            if sum(max(0, int((middle - load) // size)) for load in loads) <= n:
                low = middle
            else:
                high = middle
        given = [max(0, int((low - load) // size)) for load in loads]
    rounds = (n - sum(given)) // shards if sum(room) <= n else 0
    given = [g + rounds for g in given]
    heap = [(load + g * size, i) for i, (load, g) in enumerate(zip(loads, given, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(given)):
        load, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    for i, g in enumerate(given):
        loads[i] += g * size
    return given


def deal(classes: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (class, groups, bytes), largest class first, the first rank beyond each shard's."""
    loads = [0.0] * shards
    out = []
    for size, n, total in sorted(classes, reverse=True):
        bounds, at = [], 0
        for g in deal_class(loads, total / n, n):
            at += g
            bounds.append(at)
        out.append((size, bounds))
    return out


def schedule(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus one; slot counts the rows of a shard from 0.
    """
    spark = docs.sparkSession
    rows = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("digest"),
        )
    )
    length = F.length(F.bin("bytes"))
    groups = materialise(
        rows.groupBy("digest")
        .agg(F.sum("size").alias("bytes"))
        .withColumn("cut", F.greatest(length - PRECISION, F.lit(0)).cast("int"))
        .select("digest", "bytes", F.expr("shiftleft(shiftright(bytes, cut), cut)").alias("class"), leading_bucket(F.col("digest")).alias("bucket"))
    )
    classes = groups.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()
    dealt = deal([tuple(c) for c in classes], shards)
    bounds = spark.createDataFrame(pd.DataFrame(dealt, columns=["class", "bounds"]), "class long, bounds array<long>")
    placed = (
        gapless_rank(groups, "class", "bucket", ["digest"], "place")
        .join(F.broadcast(bounds), "class")  # at most one row for each class
        .select("digest", F.expr("size(filter(bounds, b -> b <= place))").alias("shard"))
    )
    out = materialise(join_one(rows, materialise(placed), "digest").select("doc_id", "size", "text_crc32", "shard", row_bucket("doc_id", "text_crc32", "size").alias("bucket")))
    return gapless_rank(out, "shard", "bucket", ["doc_id", "text_crc32", "size"], "slot").drop("bucket")
