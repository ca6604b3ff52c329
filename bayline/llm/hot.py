"""Joins of many rows to one row a key, with the keys that hold a large share of the rows split off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than SHARE of all rows, so there are fewer than HOT_KEYS of them.
SHARE, HOT_KEYS, TRACKED = 1 / 256, 256, 4096


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """The hashes of the keys that have more than SHARE of rows, HOT_KEYS at most.

    They come out of one mergeable sketch of TRACKED counters a task: nothing is shuffled but
    sketches. What the sketch gets wrong changes the work, never a result.
    """
    found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(xxhash64(`{key}`), {HOT_KEYS}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in found.top or [] if x["count"] > max(1, found.n * SHARE)]


def join_one(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """many with the columns of one, which has a row for each key; rows without a partner go.

    Hot keys of many meet a broadcast of their rows of one, HOT_KEYS rows at most, so no task gets
    all rows of such a key. many and one are read twice: they should be written tables or cheap.
    """
    hot = hot_keys(many, key)
    if not hot:
        return many.join(one, key)
    is_hot = F.xxhash64(key).isin(hot)
    return many.where(~is_hot).join(one.where(~is_hot), key).unionByName(many.where(is_hot).join(F.broadcast(one.where(is_hot)), key))
