"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(SCALE * x), and are written once. A sample of SAMPLE vectors, known
to every task, gives each query a lower bound of its kth best score. Queries go in batches of
about QUERIES, a broadcast of bounded size; for each batch every task reads its candidates in
blocks, without a shuffle. In a block, every dimension's list is sorted once. A query reads all
its lists in step, from the top where its weight is positive and from the bottom where it is
negative; each candidate met is scored in full. No candidate still unmet can score more than the
sum of weight times next value, so reading stops once the kth best score, of the block, of the
task's blocks before or of the sample, is above that bound: often before anything is read. The
depth doubles between two looks at the bound. Only candidates that reach the query's bound leave a
task, k at most, and meet in a final top k.

A vector that is null or holds a null or non-finite component takes no part, nor does a row
without an id. Rows that repeat an id are each a candidate; of a query's id the least vector is
the query, and no row with its id is a candidate for it. Shorter vectors count as padded with
zeros. Ties go to the smaller id. Other columns are not looked at. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.llm.store import discard, materialise

SCALE = 1024
BLOCK = 4096
QUERIES = 4096
SAMPLE = 8192
FIRST_DEPTH = 16
RESULT = "query_id long, vec_id long, score long"
#: A lower bound that every score reaches.
NONE = -(1 << 62)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(SCALE * x); leaves out the vectors that take no part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
        .where(finite)
        .select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _width(lists: pa.Array) -> int:
    return int(lists.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))


def _exact(data: np.ndarray, weights: np.ndarray) -> type:
    """A type that holds the inner products exactly: doubles below 2**53, longs below 2**63."""
    largest = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    total = largest(data) * largest(weights) * data.shape[1]
    return np.float64 if total < 1 << 53 else np.int64 if total < 1 << 62 else object


def threshold_search(ids: np.ndarray, data: np.ndarray, order: np.ndarray, own: int, weights: np.ndarray, k: int, least: int = NONE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best rows of data for one query that score at least least: (rows, scores, depth read).

    ids ascend; order holds each dimension's rows by falling value. Rows whose id is own are passed
    over.
    """
    n = len(ids)
    up, down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
    seen = np.zeros(n, bool)
    best, scores = np.empty(0, np.int64), np.empty(0, data.dtype)
    read, depth = 0, FIRST_DEPTH
    while read < n:
        bound = weights[up] @ data[order[read, up], up] + weights[down] @ data[order[n - 1 - read, down], down]
        if least > bound or (len(best) == k and scores[-1] > bound):
            break
        depth = min(depth, n)
        met = np.concatenate([order[read:depth, up].ravel(), order[n - depth : n - read, down].ravel()])
        fresh = np.zeros(n, bool)
        fresh[met] = True
        if not len(up) + len(down):  # all weights are zero: every score is
            fresh[:] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        rows = rows[ids[rows] != own]
        new = data[rows] @ weights
        best, scores = np.concatenate([best, rows[new >= least]]), np.concatenate([scores, new[new >= least]])
        keep = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[keep], scores[keep]
        read, depth = depth, 2 * depth
    return best, scores, read


class Search:
    """The best candidates of a batch of queries, block after block."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> None:
        self.ids, self.weights, self.k = ids, weights, k
        self.least = least.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id)

    def read(self, ids: np.ndarray, lists: pa.Array) -> None:
        """Search one block."""
        width = max(_width(lists), self.weights.shape[1], 1)
        sort = np.argsort(ids, kind="stable")
        ids, data = ids[sort], _matrix(lists, width)[sort]
        weights = np.pad(self.weights, ((0, 0), (0, width - self.weights.shape[1])))
        kind = _exact(data, weights)
        data, weights = data.astype(kind), weights.astype(kind)
        order = np.argsort(-data, axis=0, kind="stable")
        highest = np.maximum(weights, 0) @ data.max(axis=0) + np.minimum(weights, 0) @ data.min(axis=0)
        for q in np.flatnonzero(highest >= self.least):
            best, scores, _ = threshold_search(ids, data, order, self.ids[q], weights[q], self.k, int(self.least[q]))
            if len(best):
                kept = self.found[q]
                kept += [(-int(s), int(i)) for s, i in zip(scores, ids[best], strict=True)]
                kept.sort()
                del kept[self.k :]
                if len(kept) == self.k:
                    self.least[q] = max(self.least[q], -kept[-1][0])

    def rows(self) -> pa.RecordBatch:
        """What was found, as rows of RESULT."""
        rows = [(q, i, -s) for q, kept in zip(self.ids.tolist(), self.found, strict=True) for s, i in kept]
        return pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])


def search_blocks(batch: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads candidates (vec_id, v) and gives the best of a task for each query of the batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*batch.value, k)
        waiting: list[pa.RecordBatch] = []

        def block() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            for at in range(0, table.num_rows, BLOCK):
                part = table.slice(at, BLOCK)
                search.read(part["vec_id"].to_numpy(), part["v"].combine_chunks())

        for rows in batches:
            waiting.append(rows)
            if sum(r.num_rows for r in waiting) >= BLOCK:
                block()
        if sum(r.num_rows for r in waiting):
            block()
        yield search.rows()

    return read


def lower_bounds(sample: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to queries (vec_id, v) least, their kth best score among the sample, which no kth best of all is below."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sample.value
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                own, lists = part.column(0).to_numpy(), part.column(1)
                width = max(_width(lists), vectors.shape[1], 1)
                data, weights = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))), _matrix(lists, width)
                kind = _exact(data, weights)
                scores = weights.astype(kind) @ data.astype(kind).T
                scores[own[:, None] == ids[None]] = NONE
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(own), NONE)
                yield pa.record_batch([part.column(0), lists, pa.array([int(x) for x in least], pa.int64())], ["vec_id", "v", "least"])

    return read


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(table["v"].chunks) if table.num_rows else pa.array([], pa.list_(pa.int64()))
    return table["vec_id"].to_numpy(), _matrix(lists, max(_width(lists), 1))


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """The k best other vectors of each query: query_id, rank from 1, vec_id, score.

    vectors comes from integer_vectors(); queries is a condition on vec_id.
    """
    spark = vectors.sparkSession
    # scoring is all work and little data, so few partitions are spread over all cores
    cores = spark.sparkContext.defaultParallelism
    vectors = materialise(vectors if vectors.rdd.getNumPartitions() >= cores else vectors.repartition(cores))
    asked = vectors.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = spark.sparkContext.broadcast(_arrays(vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()))
    asked = materialise(asked.mapInArrow(lower_bounds(sample, k), "vec_id long, v array<long>, least long"))
    batches = max(1, -(-asked.count() // QUERIES))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    paths = []
    for i in range(batches):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == i).toArrow()  # about QUERIES rows
        batch = spark.sparkContext.broadcast((*_arrays(own), own["least"].to_numpy()))
        found = vectors.mapInArrow(search_blocks(batch, k), RESULT).withColumn("rank", rank).where(F.col("rank") <= k)
        paths.append(materialise(found.select("query_id", "rank", "vec_id", "score"))._bayline_path)
    discard(vectors, asked)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*paths)
