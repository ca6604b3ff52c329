"""Content-defined chunking of payloads, a deduplicated chunk store, and verified media read back.

A payload's chunks end where the top MASK_BITS bits of the rolling gear hash of the last WINDOW
bytes are zero, not before MIN_CHUNK and at MAX_CHUNK at the latest; with these sizes a chunk has
about 1 KB, so most texts have several and equal passages give equal chunks wherever they stand.
The store holds each distinct chunk once under its SHA-256. Every payload is an ordered list of
digests; joining the lists with the store and putting each payload's chunks in order gives the
media back. Every chunk and every payload is checked against its digest on the way.

The stored form of a payload (its media) is MAGIC and, for each chunk in order, the lengths of
the chunk and of its compressed form (4 bytes each, little-endian), its digest, and the form.

Null and empty texts give a payload of 64 zero bytes. Equal payloads are stored and read back
once, so copies cost a row of one digest each. Repeated rows and null ids each keep their row.
A very long text is many chunks, of which a task holds those of one payload at a time. Columns of
docs that are named like a result's column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.llm.hot import join_one
from bayline.llm.store import discard, materialise

WINDOW = 32
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 256, 10, 8192
LEVEL = 3
#: Turns by digest, and by payload, so that only a share of all chunks is held twice at a time.
TURNS = 6
MAGIC = b"GEARCHK2"
UNIT = 64
#: Digests that a task remembers as already sent.
REMEMBERED = 500_000
_PIECE = 4 << 20
_GEAR = np.random.default_rng(1009).integers(0, 1 << 32, 256, dtype=np.uint32)

MEDIA = "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded_payload(text: Column) -> Column:
    """A text's UTF-8 bytes and zeros up to a positive multiple of UNIT."""
    text = F.coalesce(text, F.lit(""))
    short = F.lit(UNIT) - F.octet_length(text) % UNIT
    fill = F.when((short == UNIT) & (F.octet_length(text) > 0), F.lit(0)).otherwise(short)
    return F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("00"), fill)))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gears of the last WINDOW bytes, each shifted by its age."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def cut_points(data: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of the payloads that begin at starts in data, relative to each start.

    All payloads are hashed in one go: a window that reaches into the payload before ends within
    the first WINDOW bytes, where no chunk may end.
    """
    n = len(data)
    marks = [np.empty(0, np.int64)]
    for at in range(0, n, _PIECE):
        begin = max(0, at - WINDOW + 1)
        h = gear_hashes(data[begin : at + _PIECE])[at - begin :]
        marks.append(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + at + 1)
    marks = np.concatenate(marks).tolist()
    out, i, bounds = [], 0, [*starts.tolist(), n]
    for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
        ends, last = [], start
        while last < stop:
            if stop - last <= MIN_CHUNK:
                end = stop
            else:
                i = bisect.bisect_left(marks, last + MIN_CHUNK, i)
                end = min(marks[i] if i < len(marks) else n, last + MAX_CHUNK, stop)
            ends.append(end - start)
            last = end
        out.append(ends)
    return out


def chunks(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, chunk) of a payload's chunks in order."""
    return next(payload_chunks(pa.array([payload], pa.binary())))[1]


def payload_chunks(column: pa.Array) -> Iterator[tuple[bytes, Iterator[tuple[bytes, bytes]]]]:
    """Each payload of a binary column with its (digest, chunk) pairs in order."""

    def cut(payload: bytes, ends: list[int]) -> Iterator[tuple[bytes, bytes]]:
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            yield hashlib.sha256(payload[a:b]).digest(), payload[a:b]

    payloads = column.to_pylist()
    starts = np.cumsum([0, *(len(p) for p in payloads[:-1])])
    for payload, ends in zip(payloads, cut_points(np.frombuffer(b"".join(payloads), np.uint8), starts) if payloads else (), strict=True):
        yield payload, cut(payload, ends)


def _runs(column: pa.Array) -> Iterator[pa.Array]:
    """A binary column in runs of about _PIECE bytes."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PIECE, side="right")))
        yield column[at:end]
        at = end


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads as rows of SPLIT: their chunks, each once a task as far as it remembers, and their chunk lists."""
    packer, sent = zstandard.ZstdCompressor(level=LEVEL), set()
    for batch in batches:
        for run in _runs(batch.column(0)):
            rows: dict[bytes, tuple[int, int, bytes]] = {}
            for payload, found in payload_chunks(run):
                whole = hashlib.sha256(payload).digest()
                key = b"list" + whole
                if key in sent or key in rows:
                    continue
                digests = []
                for digest, chunk in found:
                    digests.append(digest)
                    if digest not in sent and digest not in rows:
                        rows[digest] = (digest[0] % TURNS, len(chunk), packer.compress(chunk))
                rows[key] = (TURNS, len(payload), b"".join(digests))
            if len(sent) >= REMEMBERED:
                sent.clear()
            sent.update(rows)
            turn, length, data = zip(*rows.values(), strict=True) if rows else ((), (), ())
            keys = [k[-32:] for k in rows]
            yield pa.record_batch([pa.array(turn, pa.int32()), pa.array(keys, pa.binary()), pa.array(length, pa.int32()), pa.array(data, pa.binary())], ["turn", "key", "length", "data"])


SPLIT = "turn int, key binary, length int, data binary"


def split_payloads(payloads: DataFrame) -> DataFrame:
    """Rows of SPLIT in one pass over the payloads, written by turn: TURNS turns of chunks, then the lists."""
    return materialise(payloads.mapInArrow(_split, SPLIT), by="turn")


def chunk_lists(split: DataFrame) -> DataFrame:
    """(payload, seq, digest): the ordered chunk list of each distinct payload, written to the shared folder."""
    packed = split.where(F.col("turn") == TURNS).groupBy(F.col("key").alias("payload")).agg(F.first("data").alias("digests"))
    cut = F.expr("transform(sequence(0, cast(length(digests) / 32 as int) - 1), i -> substring(digests, 32 * i + 1, 32))")
    return materialise(packed.select("payload", F.posexplode(cut).alias("seq", "digest")))


def chunk_store(split: DataFrame, turn: int) -> DataFrame:
    """(digest, length, stored): each distinct chunk of a turn once, compressed, written to the shared folder."""
    rows = split.where(F.col("turn") == turn).groupBy(F.col("key").alias("digest"))
    return materialise(rows.agg(F.first("length").alias("length"), F.first("data").alias("stored")))


def chunk_sharing(lists: DataFrame) -> DataFrame:
    """One row: payloads, those of several chunks, list entries, distinct chunks, and those that several payloads share."""
    by_payload = lists.groupBy("payload").agg(F.count("*").alias("n")).agg(F.count("*").alias("payloads"), F.count_if(F.col("n") > 1).alias("of_several"), F.sum("n").alias("entries"))
    by_digest = lists.select("digest", "payload").distinct().groupBy("digest").agg(F.count("*").alias("n")).agg(F.count("*").alias("chunks"), F.count_if(F.col("n") > 1).alias("shared"))
    return by_payload.crossJoin(by_digest)  # one row beside one row


def describe(samples: np.ndarray) -> str:
    """Features of 8-bit samples: mean, deviation, peak, crossings of the mean, entropy."""
    share = np.bincount(samples, minlength=256) / len(samples)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(0.0, share @ (levels - mean) ** 2)))
    above = samples > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={mean:.4f},deviation={deviation:.4f},peak={int(samples.max())},crossings={crossings},entropy={entropy:.4f}"


def restore(parts: Iterable[tuple[bytes, int, bytes]]) -> tuple[bytes, bytes]:
    """(payload, media) from the (digest, length, stored) of a payload's chunks in order."""
    unpacker, payload, media = zstandard.ZstdDecompressor(), [], [MAGIC]
    for digest, length, stored in parts:
        chunk = unpacker.decompress(stored, max_output_size=length)
        if hashlib.sha256(chunk).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} does not match its digest")
        payload.append(chunk)
        media += [struct.pack("<II", length, len(stored)), digest, stored]
    return b"".join(payload), b"".join(media)


def media_row(whole: bytes, parts: Iterable[tuple[bytes, int, bytes]]) -> tuple:
    """A payload's row of MEDIA from its chunks, checked against its digest."""
    payload, media = restore(parts)
    found = hashlib.sha256(payload)
    if found.digest() != whole:
        raise ValueError(f"payload {whole.hex()} does not match its digest")
    samples = np.frombuffer(payload, np.uint8)
    return whole, len(payload), found.hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)


_MEDIA_TYPES = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
_MEDIA_NAMES = [c.strip().split(" ")[0] for c in MEDIA.split(",")]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of MEDIA from (payload, digest, length, stored), sorted by payload and place."""
    whole: bytes | None = None
    parts: list[tuple[bytes, int, bytes]] = []

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in _MEDIA_TYPES]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _MEDIA_TYPES, strict=True)], _MEDIA_NAMES)

    for batch in batches:
        rows = []
        for payload, *part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if payload != whole:
                if parts:
                    rows.append(media_row(whole, parts))
                whole, parts = payload, []
            parts.append(tuple(part))
        yield pack(rows)
    if parts:
        yield pack([media_row(whole, parts)])


def list_pieces(lists: DataFrame, store: DataFrame, turn: int) -> DataFrame:
    """The list entries of a turn with their chunks, written to the shared folder by the payload's part."""
    own = F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int") % TURNS == turn
    return materialise(join_one(lists.where(own), store, "digest").withColumn("part", F.pmod(F.xxhash64("payload"), F.lit(TURNS))), by="part")


def read_media(pieces: list[DataFrame], part: int) -> DataFrame:
    """Every payload of a part put together again from its pieces and described, in columns MEDIA.

    The pieces are dealt and sorted by payload and place and read in one pass a task.
    """
    rows = reduce(DataFrame.unionByName, pieces).where(F.col("part") == part)
    ordered = rows.repartition("payload").sortWithinPartitions("payload", "seq")
    return ordered.select("payload", "digest", "length", "stored").mapInArrow(_assemble, MEDIA)


def stored_media(payloads: DataFrame, keep: str | None = None) -> DataFrame:
    """Store all payloads as chunks and read each distinct one back: a row of MEDIA, written to the shared folder.

    With keep, the store and the lists stay in that folder as Parquet tables chunks and lists.
    """
    split = split_payloads(payloads)
    lists = chunk_lists(split)
    if keep:
        lists.write.parquet(f"{keep}/lists")
    pieces = []
    for turn in range(TURNS):
        store = chunk_store(split, turn)
        discard(split, part=f"turn={turn}")
        if keep:
            store.write.mode("append").parquet(f"{keep}/chunks")
        pieces.append(list_pieces(lists, store, turn))
        discard(store)
    media = []
    for part in range(TURNS):
        media.append(materialise(read_media(pieces, part)))
        discard(*pieces, part=f"part={part}")
    discard(split, lists, *pieces)
    return reduce(DataFrame.unionByName, media)


def media_columns(docs: DataFrame, text: str = "text", keep: str | None = None) -> DataFrame:
    """docs without its text, with n_bytes and the columns of MEDIA but the binary key."""
    docs = docs.drop(*_MEDIA_NAMES)
    payload = padded_payload(F.col(text))
    media = stored_media(docs.select(payload.alias("payload")), keep)
    keyed = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "payload": F.unhex(F.sha2(payload, 256))}).drop(text)
    return join_one(keyed, media, "payload").drop("payload")
