"""Vectorised 64-bit hashes of the words of many texts at once.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial over random odd byte weights modulo 2**64, finalised by multiply-xor mixing, so the
hashes of all words of a block come out of a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WEIGHTS = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed in one go; arrays of 8 bytes for each are made meanwhile.
SEGMENT = 1 << 20
_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers


def _segment_words(a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a; a text begins at each of starts."""
    a = LOWER[a]
    inside = ~SPACE[a]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = starts[starts > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_WEIGHTS[a] * power[: len(a)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)), s


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and where each text's begin.

    Returns (hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i+1]]. Works in
    segments of about SEGMENT bytes that end at a text's or a word's end.
    """
    n, at = len(data), 0
    hashes, where = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    begins = np.unique(offsets[:-1])
    while at < n:
        stop = min(n, at + SEGMENT)
        if stop < n:
            i = np.searchsorted(begins, stop, side="right") - 1
            if begins[i] > at:
                stop = int(begins[i])
            else:  # one text fills the segment: end it at white space, however far
                while stop < n and not SPACE[data[stop]]:
                    stop += 1
        own = begins[np.searchsorted(begins, at) : np.searchsorted(begins, stop)] - at
        h, s = _segment_words(data[at:stop], own)
        hashes.append(h)
        where.append(s + at)
        at = stop
    where = np.concatenate(where)
    return np.concatenate(hashes), np.searchsorted(where, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; with fewer words, of all as one."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width if width < n else 0, np.uint64)
    for i in range(width):
        total = mix(total + words[i : len(words) - width + 1 + i] * _K[i % 3])
    return np.unique(total)


def text_buffers(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about limit bytes: (first row, end, bytes, offsets).

    Null texts count as empty.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
