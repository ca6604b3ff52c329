"""Phrase collocations by set-oriented mining of sorted occurrence relations (SETM).

Texts, A-Z lower-cased, are split into pieces at . , ; : ! ? and line breaks, and pieces into words
at blanks and tabs. The first relation holds every word's occurrence as (position, word), sorted by
position; positions count on inside a piece and leave a gap between pieces, so two occurrences lie
side by side in one piece if their positions differ by one. It is written to the shared folder,
packed into blocks of about BLOCK bytes of text. Then, for each length:

* the blocks' distinct groups and their counts, cut into slices by a hash, meet the other blocks'
  slices and are added up; groups of LEAST occurrences or more get an id (group-count);
* every block gets the ids of its own groups back and drops all other occurrences (semi-join);
* the sorted occurrences that are left are merge-joined with themselves on adjacent positions: two
  frequent groups of k words, one word apart, are a group of k + 1 words, known by both ids.

Ids make groups exact: no phrase is known by its hash alone. There are about as many slices as
blocks, so neither grows with the corpus. The frequent groups of all lengths are tables, which
plain joins turn into phrases with the counts of their parts, and all sums and quotients are exact
decimals.

A null text counts as empty and has no words; a null language is `und`. Repeated rows count as
often as they stand there, whatever their ids. A very long text is a block of its own and is held
by one task. Equal scores go by count, then by phrase (ties). Columns other than the text and the
language are not looked at. Without words, as in an empty table, there are no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bayline.llm.backoff import pack, unpack
from bayline.llm.hashing import LOWER, mix, text_buffers
from bayline.llm.store import discard, materialise

#: Occurrences that make a group frequent, words of the longest phrase, phrases of a language.
LEAST, LONGEST, FIRST = 30, 4, 2000
#: A phrase goes if a longer one has at least SHARE hundredths of its occurrences.
SHARE = 80
SCALE = 2_000_000
BLOCK = 4 << 20
#: Turns in which slices are added up and blocks meet their ids, so that a share of them lies in shuffle files at a time.
TURNS = 3
#: Groups of a language that compete in one task, step by step: no step's task gets more than FIRST rows for each of its parts of the step before.
FANS = (4096, 64, 1)

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_K = np.uint64(0xD6E8FEB86659FD93)
#: Frequent groups come back in the place of a block's answer.
_GROUPS = -1


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, positions, text of each word) of the texts that offsets cut data into."""
    kind = _KIND[data]
    inside = kind == 0
    starts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[starts] = inside[starts]
    ends = starts[starts > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.cumsum(kind == _BREAK)
    text = np.searchsorted(offsets, s, side="right") - 1
    gap = np.zeros(len(s), np.int64)
    if len(s):
        gap[1:] = (np.diff(breaks[s]) > 0) | (np.diff(text) > 0)
    sizes = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(sizes), pa.py_buffer(LOWER[data[inside]])])
    return words, np.arange(len(s)) + np.cumsum(gap), text


def pack_keys(keys: list[bytes], n: np.ndarray) -> bytes:
    """Byte strings and their counts."""
    numbers = pack([np.fromiter(map(len, keys), np.int64, len(keys)), n])
    return len(numbers).to_bytes(4, "little") + numbers + zstandard.ZstdCompressor(level=1).compress(b"".join(keys))


def unpack_keys(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """What pack_keys() packed."""
    size = int.from_bytes(data[:4], "little")
    sizes, n = unpack(data[4 : 4 + size], 2)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    body = zstandard.ZstdDecompressor().decompress(data[4 + size :])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)]), n


BLOCKS = "block long, bytes long, relation binary, keys binary, totals string"


def word_blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The relation of words, block by block, written to the shared folder.

    A block's words, each behind its language and a tab, are numbered by their CRC and then by
    themselves; the relation has those numbers by position.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            nonlocal number
            size, words, positions, langs = (list(x) for x in zip(*held, strict=True))
            at = 0
            for p in positions:  # a gap between runs of texts
                p += at
                at = int(p[-1]) + 2 if len(p) else at
            coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
            codes, names = pd.factorize(np.concatenate(langs))
            width = max(1, len(coded.dictionary))
            place, found = pd.factorize(codes * width + coded.indices.to_numpy(zero_copy_only=False))
            bodies = coded.dictionary.take(pa.array(found % width)).to_pylist()
            prefixes = [f"{n}\t".encode() for n in names]
            keys = [prefixes[c] + b for c, b in zip((found // width).tolist(), bodies, strict=True)]
            order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(keys[i]), keys[i]))
            renumbered = np.empty(len(keys), np.int64)
            renumbered[order] = np.arange(len(keys))
            n = np.bincount(place, minlength=len(keys))
            totals = np.bincount(codes, minlength=len(names)).tolist()
            row = [
                number, sum(size), pack([np.concatenate(positions), renumbered[place]], True), pack_keys([keys[i] for i in order], n[order]),
                json.dumps([{"lang": str(x), "n": c} for x, c in zip(names, totals, strict=True)]),
            ]
            held.clear()
            number += 1
            return pa.record_batch([pa.array([v]) for v in row], ["block", "bytes", "relation", "keys", "totals"])

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for a, b, data, offsets in text_buffers(batch.column(0), BLOCK // 4):
                if held and sum(h[0] for h in held) + len(data) > BLOCK:
                    yield block()
                words, positions, row = occurrences(data, offsets)
                if len(words):
                    held.append((len(data), words, positions, names[a:b][row]))
        if held:
            yield block()

    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return materialise(rows.mapInArrow(read, BLOCKS))


SLICES = "part long, block long, data binary"
_COLUMNS = ["part", "block", "data"]


def _rows(parts: list[int], block: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(parts, pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(data, pa.binary())], _COLUMNS)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def word_slices(blocks: DataFrame, bits: int) -> DataFrame:
    """Each block's words and their counts, cut by the leading bits of their CRCs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = unpack_keys(data.as_py())
                keys = keys.to_pylist()
                bucket = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) >> (32 - bits)
                cuts = _cuts(bucket)
                yield _rows([int(bucket[a]) for a, _ in cuts], number, [pack_keys(keys[a:b], n[a:b]) for a, b in cuts])

    return blocks.select("block", "keys").mapInArrow(cut, SLICES)


def _answers(part: int, blocks: list[int], at: np.ndarray, sums: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
    """(the frequent ones of a slice's groups, the rank among them of each entry, block by block)."""
    frequent = np.flatnonzero(sums >= LEAST)
    rank = np.full(len(sums), -1, np.int64)
    rank[frequent] = np.arange(len(frequent))
    own = rank[at]
    data = [pack([own[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return frequent, pa.record_batch([pa.array([part] * len(data), pa.int64()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], _COLUMNS)


def add_words(table: pa.Table) -> pa.Table:
    """Add up the words of all blocks in one slice: each block's ranks, and the frequent words under block _GROUPS."""
    part, blocks = table["part"][0].as_py(), table["block"].to_pylist()
    keys, counts = zip(*(unpack_keys(x.as_py()) for x in table["data"]), strict=True)
    coded = pa.concat_arrays(keys).dictionary_encode()
    at, n = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(counts)
    sums = _sums(at, n, len(coded.dictionary))
    frequent, answers = _answers(part, blocks, at, sums, np.cumsum([0, *map(len, counts)]))
    found = pack_keys(coded.dictionary.take(pa.array(frequent)).to_pylist(), sums[frequent])
    return pa.Table.from_batches([answers, _rows([part], _GROUPS, [found])])


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


def add_groups(table: pa.Table) -> pa.Table:
    """The same for groups that are known by the ids of their first and of their last words."""
    part, blocks = table["part"][0].as_py(), table["block"].to_pylist()
    parts = [unpack(x.as_py(), 3, True) for x in table["data"]]
    left, right, n = np.concatenate(parts, axis=1)
    at, found = pd.factorize(pair_hash(left, right))
    first = np.empty(len(found), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    if (left[first][at] != left).any() or (right[first][at] != right).any():  # two groups share a hash
        _, first, at = np.unique(np.stack([left, right]), axis=1, return_index=True, return_inverse=True)
        at = at.reshape(-1)
    sums = _sums(at, n, len(first))
    frequent, answers = _answers(part, blocks, at, sums, np.cumsum([0, *(p.shape[1] for p in parts)]))
    chosen = first[frequent]
    return pa.Table.from_batches([answers, _rows([part], _GROUPS, [pack([left[chosen], right[chosen], sums[frequent]])])])


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two ids, which deals groups to slices."""
    return mix(left.astype(np.uint64) * _K + mix(right.astype(np.uint64) + np.uint64(1)))


def extend(relation: bytes, ranks: list[tuple[int, bytes]], bits: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """Semi-join a block's occurrences with the frequent groups and merge-join what is left on adjacent positions.

    ranks has the answers of the slices. Returns the relation of the groups one word longer and
    their slices.
    """
    position, at = unpack(relation, 2, True)
    found = [(part, unpack(data, 1)[0]) for part, data in sorted(ranks)]
    ids = np.concatenate([np.where(x >= 0, part << 32 | x, -1) for part, x in found]) if found else np.empty(0, np.int64)
    kept = ids[at] >= 0
    position, at = position[kept], at[kept]
    joined = np.flatnonzero(np.diff(position) == 1)
    position, width = position[joined], max(1, len(ids))
    place, key = pd.factorize(at[joined] * width + at[joined + 1])
    n, left, right = np.bincount(place, minlength=len(key)), key // width, key % width
    bucket = (pair_hash(ids[left], ids[right]) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((right, left, bucket))
    renumbered = np.empty(len(order), np.int64)
    renumbered[order] = np.arange(len(order))
    left, right, n, bucket = ids[left[order]], ids[right[order]], n[order], bucket[order]
    slices = [(int(bucket[a]), pack([left[a:b], right[a:b], n[a:b]], True)) for a, b in _cuts(bucket)]
    return pack([position, renumbered[place]], True), slices


#: The turn of a relation's rows, which are kept for the next length.
_RELATION = -1


def _in_turns(rows: DataFrame) -> DataFrame:
    """Slices, and relations under part _RELATION, written by the turn in which they are used."""
    turn = F.when(F.col("part") == _RELATION, _RELATION).otherwise(F.pmod(F.xxhash64("part"), F.lit(TURNS))).cast("int")
    return materialise(rows.withColumn("turn", turn), by="turn")


def _added_up(written: list[DataFrame], add: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The slices of all tables added up, turn by turn; each turn's slices go once that is done."""
    out = []
    for i in range(TURNS):
        rows = reduce(DataFrame.unionByName, written).where(F.col("turn") == i)
        out.append(materialise(rows.select(*_COLUMNS).groupBy("part").applyInArrow(add, SLICES)))
        for table in written:
            discard(table, part=f"turn={i}")
    return reduce(DataFrame.unionByName, out)


def _extended(relations: DataFrame, answers: DataFrame, bits: int) -> list[DataFrame]:
    """Relations of groups one word longer, and their slices, as tables of _in_turns()."""

    def use(own: pa.Table, ranks: pa.Table) -> pa.Table:
        out = []
        for number, data in zip(own["block"].to_pylist(), own["data"], strict=True):
            relation, slices = extend(data.as_py(), list(zip(ranks["part"].to_pylist(), ranks["data"].to_pylist(), strict=True)), bits)
            out.append(_rows([_RELATION, *(p for p, _ in slices)], number, [relation, *(d for _, d in slices)]))
        return pa.Table.from_batches(out, schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))

    out = []
    for i in range(TURNS):
        mine = lambda t: t.where(F.pmod(F.xxhash64("block"), F.lit(TURNS)) == i).select(*_COLUMNS).groupBy("block")  # noqa: B023, E731
        out.append(_in_turns(mine(relations).cogroup(mine(answers)).applyInArrow(use, SLICES)))
    return out


def _frequent_words(answers: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = unpack_keys(data.as_py())
                pairs = [k.decode().rpartition("\t") for k in keys.to_pylist()]
                ids = part << 32 | np.arange(len(n))
                columns = [pa.array(ids, pa.int64()), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.string()), pa.array(n, pa.int64())]
                yield pa.record_batch(columns, ["id", "lang", "word", "a"])

    return answers.where(F.col("block") == _GROUPS).select("part", "data").mapInArrow(read, "id long, lang string, word string, a long")


def _frequent_groups(answers: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                left, right, n = unpack(data.as_py(), 3)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (part << 32 | np.arange(len(n)), left, right, n)], ["id", "left", "right", "a"])

    return answers.where(F.col("block") == _GROUPS).select("part", "data").mapInArrow(read, "id long, left long, right long, a long")


def frequent_groups(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(words of each language, frequent words, frequent groups of two and more words), written tables.

    Words are (id, lang, word, a); groups (id, left, right, a), where left and right are the ids of
    all words but the last and all but the first.
    """
    blocks = word_blocks(docs, text, lang)
    totals = blocks.select(F.explode(F.from_json("totals", "array<struct<lang:string,n:long>>")).alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    totals = materialise(totals)
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(31, max(1, (size // BLOCK).bit_length()))
    answers = _added_up([_in_turns(word_slices(blocks, bits))], add_words)
    words, groups = materialise(_frequent_words(answers)), []
    relations, old = blocks.select(F.lit(0).cast("long").alias("part"), "block", F.col("relation").alias("data")), [blocks]
    for _ in range(LONGEST - 1):
        written = _extended(relations, answers, bits)
        discard(*old)
        relations, old = reduce(DataFrame.unionByName, written).where(F.col("turn") == _RELATION), written
        answers = _added_up(written, add_groups)
        groups.append(materialise(_frequent_groups(answers)))
    discard(*old)
    return totals, words, groups


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a / (left + right)), exact beyond 64 bits."""
    return F.call_function("div", _exact(a) * F.lit(SCALE).cast("decimal(7,0)"), _exact(left) + _exact(right))


def _lowest(*cuts: tuple[Column, Column]) -> Column:
    """The cut of the lowest score, the earliest of equal ones; cuts are (left, right) counts."""
    rows = [F.struct(cut_score(F.col("a"), x, y).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r")) for k, (x, y) in enumerate(cuts, 1)]
    return F.array_min(F.array(*rows))


def scored_phrases(words: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """(id, size, lang, phrase, a, l, r, score) of all frequent groups of two to four words.

    Beside its cut every group keeps what longer ones are made of: the counts of its first and
    last word, of all words but the last and all but the first, and the last word itself.
    """
    one = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), "a", F.col("a").alias("first"), F.col("a").alias("last"), F.col("a").alias("head"), F.col("a").alias("tail"))
    levels = [one]
    out = []
    for k, group in enumerate(groups, 2):
        below = levels[-1]
        p = below.select(*(F.col(c).alias(f"p_{c}") for c in below.columns))
        q = below.select(*(F.col(c).alias(f"q_{c}") for c in below.columns))
        joined = group.join(p, F.col("left") == F.col("p_id")).join(q, F.col("right") == F.col("q_id"))
        col = F.col
        cuts = {
            2: [(col("p_a"), col("q_a"))],
            3: [(col("p_first"), col("q_a")), (col("p_a"), col("q_last"))],
            4: [(col("p_first"), col("q_a")), (col("p_head"), col("q_tail")), (col("p_a"), col("q_last"))],
        }[k]
        level = materialise(
            joined.withColumn("cut", _lowest(*cuts)).select(
                "id", col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "q_last_word").alias("phrase"), col("q_last_word").alias("last_word"), "a",
                col("p_first").alias("first"), col("q_last").alias("last"), col("p_a").alias("head"), col("q_a").alias("tail"),
                "left", "right", col("cut.l").alias("l"), col("cut.r").alias("r"), col("cut.score").alias("score"),
            )
        )
        levels.append(level)
        out.append(level)
    kept = []
    for level, longer in zip(out, [*out[1:], None], strict=True):
        if longer is not None:
            # what lies in a group of two words more lies in one of one word more that is as frequent
            parts = longer.select(F.col("left").alias("id"), F.col("a").alias("most")).unionByName(longer.select(F.col("right").alias("id"), F.col("a").alias("most")))
            level = level.join(parts.groupBy("id").agg(F.max("most").alias("most")), "id", "left")
            level = level.where(F.col("most").isNull() | (_exact(F.col("most")) * 100 < _exact(F.col("a")) * SHARE))
        kept.append(level.select("lang", "phrase", "a", "l", "r", "score"))
    return reduce(DataFrame.unionByName, kept)


def first_of_each(phrases: DataFrame, first: int = FIRST) -> DataFrame:
    """phrases with rank, the first so many of each language; a language's phrases compete in parts, then among the parts' first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for fan in FANS:
        rank = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(fan))).orderBy(*order))
        phrases = phrases.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return phrases


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first collocations."""
    totals, words, groups = frequent_groups(docs, text, lang)
    found = first_of_each(scored_phrases(words, groups))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
