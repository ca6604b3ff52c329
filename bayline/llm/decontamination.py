"""Benchmark decontamination by windows of words.

Texts are brought to their lower-cased words with one space between. Every item of the benchmark
gives its windows of WINDOW consecutive words; an item with fewer words, but not none, is one
window. The distinct windows, each with the items that have it, are a table that Spark makes. It
is dealt by hash into turns of at most BOUND bytes, whose number follows from the table's measured
size; a benchmark of usual size is one turn. Each turn's windows are broadcast as a sorted array of
hashes with their bytes, and the texts are scanned: the hash of every window of a text follows from
two prefix sums, hits of the hash are verified byte by byte, and words and items of true hits are
noted on the row. Later turns add to what earlier ones noted, so no row is shuffled or joined.

Words inside any occurrence are hit. What is hit can be removed: `spans` cuts the hit words and
what lies between neighbouring ones out of the text, `documents` drops rows with a hit.

A null text has no words and stays as it is. Items without words have no window; items that repeat
an id count once, a null item id is written as the empty text. Repeated rows are scanned alike,
each by itself. A very long text is scanned as a whole by one task. Columns, whatever their names,
are passed on; the one that is added has a name of the caller's choice. An empty benchmark hits nothing,
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm.hashing import mix, text_buffers
from bayline.llm.store import materialise
from bayline.llm.words import Normalised, normalised

WINDOW = 10
#: Bytes of windows, with their hashes and items, that a turn broadcasts at most, but for one window's chance excess.
BOUND = 64 << 20
#: Bytes of text scanned together.
PIECE = 1 << 20

_WEIGHTS = np.random.default_rng(20240511).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 2**64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64; those of a usual piece are kept."""
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(n, 2 * PIECE), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) > 2 * PIECE:
            return table[:n]
        _powers[base] = table
    return _powers[base][:n]


class SpanHashes:
    """64-bit hashes of spans of data, equal for equal bytes wherever they stand, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_WEIGHTS[data] * _power(_BASE, len(data)), out=self.total[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each span from start to end."""
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(hash, size, body, item) of the distinct windows of all items; size is in words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for a, _, data, offsets in text_buffers(batch.column(1), PIECE):
                words = normalised(data, offsets)
                n = np.diff(words.bounds)
                first, last = words.runs(window)
                short = np.flatnonzero((n > 0) & (n < window))
                first = np.concatenate([first, words.bounds[short]])
                last = np.concatenate([last, words.bounds[short + 1] - 1])
                row = np.searchsorted(words.bounds, first, side="right") - 1
                start, end = words.start[first], words.end[last]
                flat = words.data.tobytes()
                body = [flat[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                hashes = SpanHashes(words.data).of(start, end).view(np.int64)
                yield pa.record_batch([pa.array(hashes), pa.array(last - first + 1, pa.int32()), pa.array(body, pa.binary()), names.take(pa.array(a + row))], ["hash", "size", "body", "item"])

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "hash long, size int, body binary, item string").distinct()


class WindowSet:
    """A turn's windows: sorted distinct hashes, where each one's windows begin, their bytes and items."""

    def __init__(self, found: pa.Table) -> None:
        order = np.argsort(found["hash"].to_numpy().view(np.uint64), kind="stable")
        hashes = found["hash"].to_numpy().view(np.uint64)[order]
        self.hashes, self.first = np.unique(hashes, return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.sizes = sorted(set(found["size"].to_numpy().tolist()))
        self.bodies = found["body"].take(pa.array(order)).combine_chunks()
        self.items = found["item"].take(pa.array(order)).combine_chunks()

    def hits(self, words: Normalised) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, last word, items) of every verified occurrence."""
        flat, spans = words.data.tobytes(), SpanHashes(words.data)
        for size in self.sizes:
            first, last = words.runs(size)
            if not len(first):
                continue
            start, end = words.start[first], words.end[last]
            hashes = spans.of(start, end)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            for i in np.flatnonzero(self.hashes[at] == hashes).tolist():
                body = flat[start[i] : end[i]]
                same = [k for k in range(self.first[at[i]], self.first[at[i] + 1]) if self.bodies[k].as_py() == body]
                if same:
                    yield int(first[i]), int(last[i]), [self.items[k].as_py() for k in same]


_TYPE = "struct<n_words:long,n_hit:long,hit:array<int>,source:array<int>,items:array<string>>"


def noted(docs: DataFrame, found: WindowSet, text: str, out: str, earlier: bool) -> DataFrame:
    """docs with a column out: numbers of words and hit words, the hit words' ranges and those of their bytes, pair by pair, and items, with what an earlier turn noted."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def scan(column: pa.Array, before: pa.Array | None) -> pa.Array:
        known, rows = shared.value, []
        for a, b, data, offsets in text_buffers(column, PIECE):
            words = normalised(data, offsets)
            marks, items = np.zeros(len(words.start) + 1, np.int64), {}
            for first, last, names in known.hits(words):
                marks[first] += 1
                marks[last + 1] -= 1
                items.setdefault(int(np.searchsorted(words.bounds, first, side="right")) - 1, set()).update(names)
            hit = np.cumsum(marks[:-1]) > 0
            for row in range(b - a):
                x, y = int(words.bounds[row]), int(words.bounds[row + 1])
                own = {"n_words": y - x, "n_hit": 0, "hit": [], "source": [], "items": sorted(items.get(row, ()))}
                mine = hit[x:y].copy()
                if before is not None and (old := before[a + row].as_py())["hit"]:
                    for p, q in zip(old["hit"][::2], old["hit"][1::2], strict=True):
                        mine[p:q] = True
                    own["items"] = sorted({*own["items"], *old["items"]})
                if mine.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
                    own["n_hit"], own["hit"] = int(mine.sum()), edges.tolist()
                    lengths = words.end[x:y] - words.start[x:y]
                    source = words.source[x:y] - offsets[row]
                    own["source"] = np.stack([source[edges[::2]], source[edges[1::2] - 1] + lengths[edges[1::2] - 1]], 1).reshape(-1).tolist()
                rows.append(own)
        return pa.array(rows, kind)

    def begin(column: pa.Array) -> pa.Array:
        return scan(column, None)

    def go_on(column: pa.Array, before: pa.Array) -> pa.Array:
        return scan(column, before)

    return docs.withColumn(out, F.arrow_udf(go_on, _TYPE)(F.col(text), F.col(out)) if earlier else F.arrow_udf(begin, _TYPE)(F.col(text)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """docs with a column out of words, hit ranges of words and of bytes, and items."""
    table = materialise(windows(benchmark, window, item, item_text))
    size = table.agg(F.coalesce(F.sum(F.length("body") + F.octet_length("item") + 24), F.lit(0))).first()[0]
    turns = max(1, -(-size // BOUND))
    for turn in range(turns):
        own = table.where(F.pmod(F.xxhash64("hash", "item"), F.lit(turns)) == turn)
        docs = noted(docs, WindowSet(own.toArrow()), text, out, turn > 0)
        if turn + 1 < turns:
            docs = materialise(docs)
    return docs


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs without what the benchmark has: with remove="spans" hit words are cut out, with "documents" rows go."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove}")
    found = contamination(docs, benchmark, window, text, out="__noted")
    if remove == "documents":
        return found.where(F.col("__noted.n_hit") == 0).select(docs.columns)

    @F.arrow_udf("string")
    def cut(column: pa.Array, source: pa.Array) -> pa.Array:
        out = []
        for body, edges in zip(column.to_pylist(), source.to_pylist(), strict=True):
            if body is not None and edges:
                data, at, parts = body.encode(), 0, []
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    parts.append(data[at:a])
                    at = b
                body = b"".join([*parts, data[at:]]).decode()
            out.append(body)
        return pa.array(out, pa.string())

    return found.withColumn(text, cut(F.col(text), F.col("__noted.source"))).select(docs.columns)
