"""Byte-level BPE with a lexicon of the corpus's frequent words.

Words are what the tokenizer's own pattern cuts a text into. All words of the corpus are counted;
the LEXICON most frequent ones (a documented size, not a limit on what is encoded) and their ids
form a minimal acyclic transducer that workers memory-map. A word outside it is merged exactly, in
the order of the merge list: many such words at once, those above LONG bytes each by itself with a
heap over a linked list, in near-linear time however long they are. Each worker remembers the
words it has met.

The ids equal those of the tokenizers library's encode(text, add_special_tokens=False) with the
same file; the added tokens' own texts become their ids, as there. Decoding gives the bytes of
the ids back, so a text survives the round trip.

A null text counts as empty: no ids, an empty decoded text. Repeated rows are encoded alike. A
very long text is held, with its ids, by one task. Words that occur equally often (ties) enter the
lexicon together or not at all, as far as their class of counts goes; ids do not depend on it.
Columns other than the text are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from bayline.llm import transducer
from bayline.llm.frequent import most_frequent

LEXICON = 1 << 16
#: Longer words, in bytes, are kept out of the lexicon and merged one by one.
LONG = 64
#: Words a worker remembers or counts before it starts anew.
REMEMBERED = 200_000
#: Texts encoded at once.
ROWS = 512
NO_RANK = np.iinfo(np.int32).max
#: White space as the tokenizer's own engine knows it.
_SPACE = r"[\t-\r \x85\xa0  -     　]"


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks, token bytes and the word pattern of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        letters, model = _byte_letters(), found["model"]
        vocab = model["vocab"]
        added = {x["content"]: x["id"] for x in found["added_tokens"]}
        self.added = added
        tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for text, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in text)
        for text, i in added.items():
            tokens[i] = text.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of: dict[int, int] | None = None
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.pattern = regex.compile(word_pattern())
        self.narrow = re.compile(narrow_pattern())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def words(self, text: str) -> list[str]:
        """The words of a text; an added token's text is one word."""
        find = self.pattern.findall
        try:
            text.encode("latin-1")
            find = self.narrow.findall
        except UnicodeEncodeError:
            pass
        if self.cut is None or not any(t in text for t in self.added):
            return find(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else find(part)
        return out

    def ranked(self, key: np.ndarray) -> np.ndarray:
        """The rank in the merge list of each pair of symbols, NO_RANK for those not in it."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word: of all pairs that stand in it the first of lowest rank is merged, until none is left."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, merged = self.rank_of.get, self.merged
        start = self.first[np.frombuffer(word, np.uint8)]
        ranks = self.ranked(start[:-1] << 32 | start[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        symbols, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 32 | symbols[j]) != rank:
                continue  # merged away, or into another pair, meanwhile
            symbols[i], symbols[j] = int(merged[rank]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := rank_of(symbols[a] << 32 | symbols[b])) is not None:
                    heapq.heappush(heap, (r, a))
        out = np.array(symbols, np.int64)
        return out[out >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge pairs in the order of the merge list, in all words at once: (ids, ids of each word)."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        long = np.flatnonzero(lengths > LONG)
        short = (lengths <= LONG)[word]
        symbols, word = symbols[short], word[short]
        finished = [(np.full(len(ids), i), ids) for i in long.tolist() for ids in (self.merge_long(words[i]),)]
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK, np.int64)
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranked(symbols[:-1] << 32 | symbols[1:]), NO_RANK)
            begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(word))))
            done = low == NO_RANK
            finished.append((word[done], symbols[done]))
            i = np.flatnonzero((rank == low) & ~done)
            if len(i):  # of pairs that overlap, as in aaa, every second one from the left
                run = np.flatnonzero(np.concatenate([[True], np.diff(i) != 1]))
                place = np.arange(len(i)) - np.repeat(run, np.diff(np.append(run, len(i))))
                i = i[place % 2 == 0]
                symbols[i] = self.merged[rank[i]]
            keep = ~done
            keep[i + 1] = False
            symbols, word = symbols[keep], word[keep]
        owner = np.concatenate([np.empty(0, np.int64), *(w for w, _ in finished)])
        ids = np.concatenate([np.empty(0, np.int64), *(x for _, x in finished)])
        return ids[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))


def word_pattern() -> str:
    """The byte-level pattern with white space spelled out, for engines differ in what it covers."""
    inner = _SPACE[1:-1]
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{inner}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{inner}])|{_SPACE}+"


def narrow_pattern() -> str:
    """The same for texts whose code points lie below 256, letters and numbers spelled out."""
    kinds = lambda kind: "".join(rf"\x{i:02x}" for i in range(256) if unicodedata.category(chr(i))[0] == kind)
    letter, number, inner = kinds("L"), kinds("N"), r"\t-\r \x85\xa0"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{inner}{letter}{number}]+|[{inner}]+(?![^{inner}])|[{inner}]+"


_vocabularies: dict[str, Vocabulary] = {}
_lexicons: dict[str, transducer.Transducer] = {}


def vocabulary(path: str) -> Vocabulary:
    """The tokenizer file at path, read once in each process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, counts = vocabulary(path), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    counts.update(voc.words(value.as_py()))
                    if len(counts) > REMEMBERED:
                        yield rows()
        yield rows()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, path: str, size: int = LEXICON, text: str = "text") -> str:
    """Compile the size most frequent words and hand the file to Spark, which gives it to every executor."""
    voc = vocabulary(path)
    top = most_frequent(word_counts(docs, path, text).where(F.octet_length("word") <= LONG), size).select("word").collect()
    words = sorted(r.word.encode() for r in top if r.word not in voc.added)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(file, "wb") as out:
        ids, sizes = voc.merge(words)
        out.write(transducer.build(zip(words, map(tuple, np.split(ids, np.cumsum(sizes)[:-1])) if words else (), strict=True)))
    docs.sparkSession.sparkContext.addFile(file)
    return name


class _Known(dict):
    """Numbers words as they come; the new ones wait in fresh."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Encodes texts in a worker and remembers the words it has met."""

    def __init__(self, path: str, lexicon: transducer.Transducer | None = None) -> None:
        self.voc, self.lexicon = vocabulary(path), lexicon
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = _Known(), np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        if not fresh:
            return
        words = [w.encode() for w in fresh]
        found, ids, sizes = self.lexicon.lookup(words) if self.lexicon else (np.zeros(len(words), bool), np.empty(0, np.int32), np.zeros(len(words), np.int64))
        added = np.array([self.voc.added.get(w, -1) for w in fresh] if self.voc.added else [-1] * len(fresh))
        rest = np.flatnonzero(~found & (added < 0))
        merged, merged_sizes = self.voc.merge([words[i] for i in rest])
        special = np.flatnonzero(added >= 0)
        sizes[rest], sizes[special] = merged_sizes, 1
        owner = np.concatenate([np.repeat(np.flatnonzero(found), sizes[found]), np.repeat(rest, merged_sizes), special])
        ids = np.concatenate([ids, merged, added[special].astype(np.int32)])[np.argsort(owner, kind="stable")]
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        number, parts = self.known.__getitem__, []
        for text in texts:
            words = self.voc.words(text) if text else []
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn()
        words = np.concatenate([np.empty(0, np.int64), *parts])
        begins, sizes = self.ends[words], self.ends[words + 1] - self.ends[words]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.cumsum([0, *(len(p) for p in parts)])]


def _open_encoder(path: str, lexicon: str) -> Encoder:
    return Encoder(path, transducer.Transducer.map(SparkFiles.get(lexicon)))


def _encode_array(encoder: Encoder, texts: pa.Array) -> pa.Array:
    ids, ends = encoder.encode(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode_column(text: Column, path: str, lexicon: str) -> Column:
    """The ids of each text of a column, an array of integers; lexicon comes from compile_lexicon()."""

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _open_encoder(path, lexicon)  # what it remembers goes with the task
        for column in columns:
            parts = [_encode_array(encoder, column[at : at + ROWS]) for at in range(0, len(column), ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def decode_ids(voc: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all ids, where each id's end)."""
    sizes = voc.lengths[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return voc.bytes[np.repeat(voc.starts[ids] - (ends - sizes), sizes) + np.arange(total)], ends


def _decode_array(voc: Vocabulary, lists: pa.Array) -> pa.Array:
    offsets = lists.offsets.to_numpy()
    data, ends = decode_ids(voc, lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
    cuts = np.concatenate([[0], ends])[offsets - offsets[0]]
    flat = data.tobytes()
    return pa.array([flat[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of ids; bytes that are no UTF-8 become replacement marks."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return _decode_array(vocabulary(path), column)

    return decode(ids)


def encode_documents(docs: DataFrame, path: str | None = None, size: int = LEXICON) -> DataFrame:
    """docs with the columns ids (array<int>) and decoded (string), the text that these ids give.

    Columns of docs with these names are replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.drop("ids", "decoded")
    lexicon = compile_lexicon(docs, path, size)
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    at = docs.columns.index("text")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = _open_encoder(path, lexicon), schema.names
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                ids = _encode_array(encoder, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, _decode_array(encoder.voc, ids)], names)

    return docs.mapInArrow(both, schema)
