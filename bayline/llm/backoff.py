"""Word n-gram scoring with a weighted backoff automaton.

Tokens are the words of a text, A-Z lower-cased, and then one end. Counts are over all training
texts. The base model is the smoothed unigram, log10((c + 0.1) / (N + 0.1 (V + 1))). The automaton
has three levels. Its root is the unigram. A word with arcs is a state below the root, a pair of
words with arcs a state below the second word's. An arc stands for every pair, and every triple,
of words that follow one another more than once in the training texts, weighted by its discounted
probability; a failure arc leads from a pair to its second word and from a word to the root, with
the probability left over, scaled so that each state's probabilities add up to one. The thresholds
are counts, so states and arcs grow with the corpus.

A text is scored in one traversal from left to right that carries the state: an arc on the next
word gives its weight and the next state; without one the failure arc is taken and the word is
tried again. A text begins in the state of the end. All texts of a block are traversed side by
side; long ones are cut into runs of RUN words, of which each begins in the state that the two
words before it lead to.

Nobody holds the whole automaton: each block of texts gets the states and arcs of its own words.
The hashed words of the texts are written to the shared folder once, packed into blocks of about
BLOCK bytes of text. A block sends its sorted distinct words and pairs, cut into slices by the leading bits of their hashes; the
slices of all blocks with the same bits meet, are added up, and each goes back to its block as an
array in the same order. There are about as many slices as blocks, so none grows with the corpus.
A second round adds up the arcs of the words and counts the triples whose pairs occur often
enough, a third adds up the arcs of the pairs; the first slice to name a gram speaks for it there.
Each block is then scored beside its own part of the automaton. Words, pairs and triples are known
by 64-bit hashes.

A null text counts as empty: it has the one token end. Without training rows all counts are zero.
Repeated rows, and equal texts, are scored alike, each by itself. A very long text is a block of
its own and is held by one task. Columns other than the id and the text are not looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.llm.hashing import mix, text_buffers, word_hashes
from bayline.llm.store import discard, materialise

SMOOTHING = 0.1
#: A pair or triple of words makes an arc if it occurs so often.
LEAST = 2
DISCOUNT = 0.5
BLOCK = 4 << 20
#: Words of a text that are traversed one after another.
RUN = 128
#: Turns in which blocks meet their counts, and slices are added up, so that only a share of them lies in shuffle files at a time.
TURNS = 3
#: Stands for the end of a text; a word hashes to it with a chance of 2**-64.
END = np.uint64(0x9E6C63D0876A9A47)
_K = np.uint64(0xD6E8FEB86659FD93)
BLOCKS = "block long, bytes long, words binary, tokens binary, sizes array<long>, ids array<long>, null_ids array<boolean>, training array<boolean>"


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash for each ordered pair of words."""
    return mix(left * _K + mix(right + np.uint64(1)))


def pack(rows: list[np.ndarray], ascending: bool = False) -> bytes:
    """Arrays of long integers, byte by byte and compressed; ascending: the first one is sorted, and kept as differences."""
    table = np.stack([x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in rows])
    if ascending:
        table[0, 1:] = np.diff(table[0])  # sorted as unsigned; differences wrap around
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1))
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, rows: int, ascending: bool = False) -> np.ndarray:
    """What pack() packed, as rows of a matrix."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    table = np.array(planes.reshape(rows, 8, -1).transpose(0, 2, 1), order="C").view(np.int64).reshape(rows, -1)
    if ascending:
        np.cumsum(table[0], out=table[0])
    return table


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, where each first stands, the place of each value among them)."""
    at, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[at[::-1]] = np.arange(len(values))[::-1]
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], first[order], place[at]


def text_blocks(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of the rows of docs, hashed and packed into blocks, written to the shared folder."""
    kind = pa.schema(
        [
            ("block", pa.int64()), ("bytes", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("sizes", pa.list_(pa.int64())),
            ("ids", pa.list_(pa.int64())), ("null_ids", pa.list_(pa.bool_())), ("training", pa.list_(pa.bool_())),
        ]
    )

    def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens with the ends, tokens of each text)."""
        words, bounds = word_hashes(data, offsets)
        ends = bounds[1:] + np.arange(len(bounds) - 1)
        tokens = np.empty(len(words) + len(ends), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = END, words
        return tokens, np.diff(bounds) + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block() -> pa.RecordBatch:
            nonlocal number
            size, tokens, sizes, ids, missing, training_rows = (list(x) for x in zip(*held, strict=True))
            words, _, at = distinct(np.concatenate(tokens))
            flat = lambda lists: [x for part in lists for x in part]
            row = [number, sum(size), pack([words], True), pack([at]), np.concatenate(sizes).tolist(), flat(ids), flat(missing), flat(training_rows)]
            held.clear()
            number += 1
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, kind, strict=True)], schema=kind)

        for batch in batches:
            ids, training_rows = batch.column(0), batch.column(2).to_pylist()
            missing = ids.is_null().to_pylist()
            ids = ids.fill_null(0).to_pylist()
            for first, last, data, offsets in text_buffers(batch.column(1), BLOCK // 4):
                if held and sum(h[0] for h in held) + len(data) > BLOCK:
                    yield block()
                held.append((len(data), *hashed(data, offsets), ids[first:last], missing[first:last], training_rows[first:last]))
        if held:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return materialise(rows.mapInArrow(read, BLOCKS))


@dataclass
class Block:
    """A block's tokens: words and an end for each text."""

    ids: list
    training: np.ndarray
    words: np.ndarray  # hashes, ascending
    tokens: np.ndarray  # places in words
    bounds: np.ndarray


def open_block(row: dict) -> Block:
    """Unpack a row of text_blocks()."""
    ids = [None if missing else i for i, missing in zip(row["ids"], row["null_ids"], strict=True)]
    words, tokens = unpack(row["words"], 1, True)[0].view(np.uint64), unpack(row["tokens"], 1)[0]
    return Block(ids, np.array(row["training"], bool), words, tokens, np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)]))


@dataclass
class Grams:
    """The sorted distinct words, pairs and triples of a block, and how they are made of one another.

    A token's pair is the token with the one before, an end if it is the first of its text. A
    token other than the first has a triple, its pair with the one before that.
    """

    words: np.ndarray
    word_at: np.ndarray  # of each token
    pairs: np.ndarray
    pair_at: np.ndarray  # of each token
    left: np.ndarray  # the words of each pair
    right: np.ndarray
    triples: np.ndarray
    triple_rows: np.ndarray  # the tokens that have a triple
    triple_at: np.ndarray  # of each of them
    context: np.ndarray  # the pair that each triple begins with
    ending: np.ndarray  # the pair that each triple ends with


def block_grams(block: Block, triples: bool = True) -> Grams:
    """The grams of a block, on demand without its triples."""
    words, at = block.words, block.tokens
    end = np.searchsorted(words, END)
    before = np.concatenate([[end], at[:-1]])
    pairs, first, pair_at = distinct(pair_hash(words[before], words[at]))
    rows = np.flatnonzero(before != end) if triples else np.empty(0, np.int64)
    found, place, triple_at = distinct(pair_hash(pairs[pair_at[rows - 1]], words[at[rows]]))
    return Grams(words, at, pairs, pair_at, before[first], at[first], found, rows, triple_at, pair_at[rows[place] - 1], pair_at[rows[place]])


SLICES = "part long, block long, data binary"
SUMS = "part long, block long, total long, distinct long, data binary"
WORDS, PAIRS, TRIPLES = 0, 1, 2


def slices(number: int, kind: int, keys: np.ndarray, values: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Sorted keys and their values, cut by the keys' leading bits, as rows of SLICES."""
    bucket = keys >> np.uint64(64 - bits)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    data = [pack([keys[a:b], *(v[a:b] for v in values)], True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    part = bucket[cuts[:-1]].astype(np.int64) | kind << 32
    return pa.record_batch([pa.array(part), pa.array(np.full(len(data), number)), pa.array(data, pa.binary())], ["part", "block", "data"])


def add_up(found: list[DataFrame], width: int) -> DataFrame:
    """Slices with width values a key, tables of write_slices(), as rows of SUMS, written to the shared folder.

    Each slice's data are the sums over all slices and whether this one is the first with the key,
    in the order of its keys. total and distinct are those of the first values, once for each key.
    The slices are added up in turns and go once that is done.
    """

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), width + 1, True) for x in table["data"]]
        every = np.concatenate(parts, axis=1)
        at, keys = pd.factorize(every[0])
        first = np.empty(len(keys), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]
        sums = [np.bincount(at, v, len(keys)).astype(np.int64) for v in every[1:]]
        own = np.zeros(every.shape[1], np.int64)
        own[first] = 1
        rows = np.stack([*(x[at] for x in sums), own])
        ends = np.cumsum([0] + [p.shape[1] for p in parts])
        data = [pack(list(rows[:, a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        once = lambda x: pa.array([int(x)] + [0] * (len(parts) - 1), pa.int64())
        return pa.table([table["part"], table["block"], once(sums[0].sum()), once((sums[0] > 0).sum()), pa.array(data, pa.binary())], names=[s.split(" ")[0] for s in SUMS.split(", ")])

    out = []
    for i in range(TURNS):
        rows = reduce(DataFrame.unionByName, found).where(F.col("turn") == i)
        out.append(materialise(rows.groupBy("part").applyInArrow(add, SUMS)))
        discard(*found, part=f"turn={i}")
    discard(*found)
    return reduce(DataFrame.unionByName, out)


def write_slices(rows: DataFrame) -> DataFrame:
    """Rows of SLICES written to the shared folder by the turn that they are added up in."""
    return materialise(rows.withColumn("turn", F.pmod(F.xxhash64("part"), F.lit(TURNS)).cast("int")), by="turn")


def by_turns(blocks: DataFrame, parts: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> list[DataFrame]:
    """What use makes of each block and its rows of parts, as a plan for each of TURNS turns."""
    own = lambda t, i: t.where(F.pmod(F.xxhash64("block"), F.lit(TURNS)) == i).groupBy("block")
    return [own(blocks, i).cogroup(own(parts, i)).applyInArrow(use, schema) for i in range(TURNS)]


def own_sums(parts: pa.Table, kind: int, width: int) -> np.ndarray:
    """A block's rows of SUMS of one kind put together again: width sums and whether it is the first, for each key."""
    rows = sorted((p, x) for p, x in zip(parts["part"].to_pylist(), parts["data"].to_pylist(), strict=True) if p >> 32 == kind)
    found = [unpack(x, width + 1) for _, x in rows]
    return np.concatenate(found, axis=1) if found else np.empty((width + 1, 0), np.int64)


def gram_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """How often training texts have the words and pairs of each block, as rows of SUMS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = open_block(row)
                grams = block_grams(block, triples=False)
                weight = np.repeat(block.training, np.diff(block.bounds))
                yield slices(row["block"], WORDS, grams.words, [np.bincount(grams.word_at, weight, len(grams.words))], bits)
                yield slices(row["block"], PAIRS, grams.pairs, [np.bincount(grams.pair_at, weight, len(grams.pairs))], bits)

    return add_up([write_slices(blocks.mapInArrow(count, SLICES))], 1)


def frequent_triples(grams: Grams, n: np.ndarray) -> np.ndarray:
    """The triples whose pairs, of which there are n each, occur often enough for the triple to do so."""
    return np.flatnonzero((n[grams.context] >= LEAST) & (n[grams.ending] >= LEAST))


def word_sums(blocks: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
    """The second round: sums over the arcs of each block's words that occur more than once, and counts of its triples.

    As rows of SUMS: of a word the arcs' counts, their number and the counts of the words they lead
    to; of a triple whose pairs occur often enough its count.
    """

    def spread(texts: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for row in texts.to_pylist():
            block = open_block(row)
            grams = block_grams(block)
            (c, _), (n, own) = own_sums(known, WORDS, 1), own_sums(known, PAIRS, 1)
            arc = (n >= LEAST) & (own > 0)
            left, size = grams.left[arc], len(grams.words)
            sums = [np.bincount(left, n[arc], size), np.bincount(left, minlength=size), np.bincount(left, c[grams.right[arc]], size)]
            out.append(slices(row["block"], WORDS, grams.words[c > 1], [x[c > 1] for x in sums], bits))
            weight = np.repeat(block.training, np.diff(block.bounds))[grams.triple_rows]
            chosen = frequent_triples(grams, n)
            triples = np.bincount(grams.triple_at, weight, len(grams.triples))[chosen]
            out.append(slices(row["block"], TRIPLES, grams.triples[chosen], [triples, np.zeros_like(triples), np.zeros_like(triples)], bits))
        return pa.Table.from_batches(out)

    return add_up([write_slices(t) for t in by_turns(blocks, counts, spread, SLICES)], 3)


def pair_sums(blocks: DataFrame, parts: DataFrame, bits: int) -> DataFrame:
    """The third round: of each block's pairs that occur often enough the arcs' counts, their number and the counts of the arcs' last pairs."""

    def spread(texts: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        first, second = (known.filter(pc.equal(known["round"], i)) for i in (1, 2))
        for row in texts.to_pylist():
            grams = block_grams(open_block(row))
            n, _ = own_sums(first, PAIRS, 1)
            chosen = frequent_triples(grams, n)
            m, _, _, own = own_sums(second, TRIPLES, 3)
            arc = (m >= LEAST) & (own > 0)
            context, size = grams.context[chosen][arc], len(grams.pairs)
            sums = [np.bincount(context, m[arc], size), np.bincount(context, minlength=size), np.bincount(context, n[grams.ending[chosen][arc]], size)]
            out.append(slices(row["block"], PAIRS, grams.pairs[n >= LEAST], [x[n >= LEAST] for x in sums], bits))
        return pa.Table.from_batches(out)

    return add_up([write_slices(t) for t in by_turns(blocks, parts, spread, SLICES)], 3)


@dataclass
class Automaton:
    """A block's part of the automaton; states are numbered, weights are log10 probabilities.

    State 0 is the root. State 1 + i is the block's word i, state 1 + words + i its pair i; those
    without arcs are never entered.
    """

    words: int
    start: int
    arcs: np.ndarray  # state * words + word, ascending
    weight: np.ndarray
    target: np.ndarray
    failure: np.ndarray  # of each state
    below: np.ndarray  # where each state's failure arc leads
    unigram: np.ndarray
    entered: np.ndarray  # the state that each word leads to from the root
    after: np.ndarray  # the state that each pair of words leads to

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Take a word in every state: the log10 probabilities; state is moved on."""
        out, left = np.zeros(len(word)), np.arange(len(word))
        while len(left):
            key = state[left] * self.words + word[left]
            arc = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            out[left[hit]] += self.weight[arc[hit]]
            state[left[hit]] = self.target[arc[hit]]
            left = left[~hit]
            root = left[state[left] == 0]
            out[root] += self.unigram[word[root]]
            left = left[state[left] != 0]
            state[root] = self.entered[word[root]]
            out[left] += self.failure[state[left]]
            state[left] = self.below[state[left]]
        return out

    def walk(self, tokens: np.ndarray, pair_at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The log10 probability of each token of the texts that bounds cut tokens into."""
        sizes = np.diff(bounds)
        runs = -(-sizes // RUN)
        text = np.repeat(np.arange(len(sizes)), runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = bounds[text] + number * RUN
        stop = np.minimum(at + RUN, bounds[text + 1])
        state = np.where(number == 0, self.start, self.after[pair_at[at - 1]] if len(at) else 0)
        out = np.empty(len(tokens))
        while len(at):
            out[at] = self.step(state, tokens[at])
            at = at + 1
            live = at < stop
            at, stop, state = at[live], stop[live], state[live]
        return out


@dataclass
class Model:
    """The counts and sums that each block's part of the automaton is made of."""

    total: int
    distinct: int
    parts: DataFrame  # round, block, part, data

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """The smoothed log10 probability of words by their counts."""
        return np.log10((counts + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))


def _left_over(spent: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """log10 of what a state's arcs leave of its probability over what they leave of the state below."""
    return np.log10(np.maximum(1 - spent, 1e-12) / np.maximum(1 - covered, 1e-12))


def automaton_part(total: int, distinct: int, grams: Grams, known: pa.Table) -> tuple[Automaton, np.ndarray]:
    """A block's part of the automaton, from its rows of Model.parts, and its words' counts."""
    of = lambda i: known.filter(pc.equal(known["round"], i))
    (c, _), (n, _) = own_sums(of(1), WORDS, 1), own_sums(of(1), PAIRS, 1)
    chosen, m = frequent_triples(grams, n), own_sums(of(2), TRIPLES, 3)[0]
    w, p = len(grams.words), len(grams.pairs)
    # failure arcs of words, then of pairs
    failure, below, state = np.zeros(1 + w + p), np.zeros(1 + w + p, np.int64), np.zeros(1 + w + p, bool)
    spent, arcs, covered, _ = own_sums(of(2), WORDS, 3)
    has = arcs > 0
    at = 1 + np.flatnonzero(c > 1)[has]
    failure[at] = _left_over((spent - DISCOUNT * arcs)[has] / c[at - 1], (covered + SMOOTHING * arcs)[has] / (total + SMOOTHING * (distinct + 1)))
    state[at] = True
    spent, arcs, covered, _ = own_sums(of(3), PAIRS, 3)
    has = arcs > 0
    at = 1 + w + np.flatnonzero(n >= LEAST)[has]
    failure[at] = _left_over((spent - DISCOUNT * arcs)[has] / n[at - 1 - w], (covered - DISCOUNT * arcs)[has] / c[grams.right[at - 1 - w]])
    state[at], below[at] = True, 1 + grams.right[at - 1 - w]
    # the longest state that a word, a pair or a triple ends in
    entered = np.where(state[1 : w + 1], 1 + np.arange(w), 0)
    after = np.where(state[1 + w :], 1 + w + np.arange(p), entered[grams.right])
    pair, triple = np.flatnonzero(n >= LEAST), np.flatnonzero(m >= LEAST)
    context, ending = grams.context[chosen[triple]], grams.ending[chosen[triple]]
    arcs = np.concatenate([(1 + grams.left[pair]) * w + grams.right[pair], (1 + w + context) * w + grams.right[ending]])
    weight = np.log10(np.concatenate([(n[pair] - DISCOUNT) / c[grams.left[pair]], (m[triple] - DISCOUNT) / n[context]]))
    target, order = np.concatenate([after[pair], after[ending]]), np.argsort(arcs)
    unigram = np.log10((c + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))
    start = entered[np.searchsorted(grams.words, END)] if w else 0
    return Automaton(w, int(start), arcs[order], weight[order], target[order], failure, below, unigram, entered, after), c


def fit_model(blocks: DataFrame) -> Model:
    """Count all training texts and add up the states' sums."""
    # about as many slices as blocks of full size
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(31, max(1, (size // BLOCK).bit_length()))
    named = lambda i, t: t.select(F.lit(i).alias("round"), "block", "part", "data")
    counts = gram_counts(blocks, bits)
    sums = word_sums(blocks, counts, bits)
    parts = named(1, counts).unionByName(named(2, sums))
    totals = counts.where(F.shiftright("part", 32) == WORDS)
    total, distinct = totals.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "distinct"))).first()
    return Model(total, distinct, parts.unionByName(named(3, pair_sums(blocks, parts, bits))))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(blocks: DataFrame, model: Model) -> DataFrame:
    """A row for each text of the blocks, in columns SCORES."""
    total, distinct = model.total, model.distinct

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        rows: list = []
        for row in texts.to_pylist():
            block = open_block(row)
            grams = block_grams(block)
            a, c = automaton_part(total, distinct, grams, known)
            known_words, chain = (c > 0)[grams.word_at].astype(np.int64), a.walk(grams.word_at, grams.pair_at, block.bounds)
            sums = [np.add.reduceat(x, block.bounds[:-1]) if len(block.ids) else np.empty(0) for x in (known_words, a.unigram[grams.word_at], chain)]
            rows += zip(block.ids, (~block.training).tolist(), np.diff(block.bounds).tolist(), *(x.tolist() for x in sums), strict=True)
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        columns.insert(4, [total] * len(rows))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[s.split(" ")[0] for s in SCORES.split(", ")])

    return reduce(DataFrame.unionByName, [materialise(t) for t in by_turns(blocks, model.parts, score, SCORES)])


def score_texts(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that training holds for and score all rows of docs."""
    blocks = text_blocks(docs, training, key, text)
    return score_blocks(blocks, fit_model(blocks))
