"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are all runs of one and two words, repeats counted; a feature's bucket is the
CRC-32 of its bytes modulo BUCKETS. A text is brought to its words with one space between and
scanned once: the running CRC of every prefix is stored. The CRC of a run of words is that of the
prefix at its end with the prefix at its start cancelled, which is shifted over the run's length
first; the shift is linear over GF(2) and done by tables. So a run costs two stored values and a
few look-ups, however long it is, and no run is hashed again.

The source's and the target's bucket counts are one row for each bucket and task, added up by
Spark; the driver holds BUCKETS numbers for each. A bucket's gain is the logarithm of the ratio of
its smoothed shares; a text's weight is the floored mean of its features' gains. Texts with at
least MIN_WORDS words get a score, the weight and a number of their id's digest, and the highest
are drawn without replacement. Ranks are places in a table sorted by ranges, so no task holds more
than its range.

A null text counts as empty: no features, weight 0, never drawn. A null id is digested as an empty
one and goes after all ids of its score. Rows that repeat an id are scored and drawn each by
itself; equal scores and ids go by weight and features, and then count as equal, so which of them
gets the earlier rank does not show (ties). Very long texts are scanned as a whole by one task.
Columns other than the id and the text are not looked at. An empty source gives no rows; against
an empty target all gains follow from the smoothing alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm.hashing import text_buffers
from bayline.llm.ranks import range_rank
from bayline.llm.store import materialise
from bayline.llm.words import Normalised, normalised

BUCKETS, LONGEST = 10_000, 2
MIN_WORDS, SHARE, SEED = 20, 25, 7
#: Bytes of text scanned together, and bytes of a row that is scanned beside the others.
PIECE, STRIDE = 1 << 20, 256

_POLYNOMIAL = 0xEDB88320
_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BYTE = np.where(_BYTE & 1, (_BYTE >> 1) ^ np.uint32(_POLYNOMIAL), _BYTE >> 1).astype(np.uint32)
_shifts: dict[int, np.ndarray] = {}


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by four tables of 256."""
    return tables[0][values & 255] ^ tables[1][values >> 8 & 255] ^ tables[2][values >> 16 & 255] ^ tables[3][values >> 24]


def shift_tables(n: int) -> np.ndarray:
    """The tables of the map that takes a CRC over n more bytes of zero; from those of powers of two."""
    if n not in _shifts:
        if n == 0:
            byte = np.arange(256, dtype=np.uint32)
            made = np.stack([byte << np.uint32(8 * i) for i in range(4)])
        elif n == 1:
            values = shift_tables(0)
            made = _BYTE[values & 255] ^ (values >> np.uint32(8))
        else:
            half = shift_tables(n // 2)
            made = _apply(half, half)
            if n % 2:
                made = _apply(shift_tables(1), made)
        if n > 4096 and n & (n - 1):
            return made
        _shifts[n] = made
    return _shifts[n]


def shifted(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each CRC taken over its own number of bytes of zero, bit by bit of the number."""
    values, bit = values.copy(), 0
    while len(sizes) and int(sizes.max()) >> bit:
        at = np.flatnonzero(sizes >> bit & 1)
        values[at] = _apply(shift_tables(1 << bit), values[at])
        bit += 1
    return values


def running_crcs(data: np.ndarray) -> np.ndarray:
    """The CRC-32 of every prefix of data, the empty one first.

    Rows of STRIDE bytes are scanned side by side, first for what each adds, then from the CRC
    that the rows before it lead to.
    """
    rows = -(-len(data) // STRIDE)
    padded = np.zeros(rows * STRIDE, np.uint8)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(padded.reshape(rows, STRIDE).T)

    def scan(state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        for i in range(STRIDE):
            state = _BYTE[(state ^ columns[i]) & 255] ^ (state >> np.uint32(8))
            if out is not None:
                out[i] = state
        return state

    added = scan(np.zeros(rows, np.uint32), None)
    tables, carry, at = shift_tables(STRIDE).tolist(), [0xFFFFFFFF], 0xFFFFFFFF
    for x in added.tolist():
        at = tables[0][at & 255] ^ tables[1][at >> 8 & 255] ^ tables[2][at >> 16 & 255] ^ tables[3][at >> 24] ^ x
        carry.append(at)
    out = np.empty((STRIDE, rows), np.uint32)
    scan(np.array(carry[:-1], np.uint32), out)
    return np.concatenate([np.zeros(1, np.uint32), ~np.ascontiguousarray(out.T).reshape(-1)[: len(data)]])


def run_crcs(words: Normalised, running: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of every run of n words."""
    first, last = words.runs(n)
    start, end = words.start[first], words.end[last]
    text = np.searchsorted(words.bounds, first, side="right") - 1
    return text, running[end] ^ shifted(running[start], end - start)


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each text, text and bucket of every feature) for runs of a column's rows."""
    for _, _, data, offsets in text_buffers(column, PIECE):
        words = normalised(data, offsets)
        running = running_crcs(words.data)
        texts, crcs = zip(*(run_crcs(words, running, n) for n in range(1, LONGEST + 1)), strict=True)
        yield np.diff(words.bounds), np.concatenate(texts), np.concatenate(crcs) % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buckets in text_features(batch.column(0)):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of the natural logarithm, rounded down."""
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for sizes, texts, buckets in text_features(batch.column(1)):
                n, total = np.bincount(texts, minlength=len(sizes)), np.zeros(len(sizes), np.int64)
                np.add.at(total, texts, shared.value[buckets])
                words.append(sizes)
                features.append(n)
                weights.append(total // np.maximum(n, 1))
            yield pa.record_batch([batch.column(0), *(pa.array(np.concatenate(x), pa.int64()) for x in (words, features, weights))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noised(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with score, the weight and a Gumbel variable that the digest of the id gives."""

    @F.pandas_udf("long")
    def noise(h: pd.Series) -> pd.Series:
        return pd.Series([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.tolist()], dtype="int64")

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return rows.withColumn("score", F.col("weight") + noise(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; undrawn rows have no rank.

    Of the rows with at least MIN_WORDS words share hundredths are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = materialise(noised(weighted(docs, gain, key, text), seed))
    able = rows.where(F.col("n_words") >= MIN_WORDS)
    drawn = able.count() * share // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features")]
    placed = range_rank(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(rows.where(F.col("n_words") < MIN_WORDS).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; a repeated id is drawn with all its rows if one of them is."""
    ids = resampled(docs, target, share=share, seed=seed).where("rank is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")
