"""A minimal acyclic transducer from words to id sequences.

Words are added in sorted order; states with equal futures are merged as soon as no later word
can change them, so suffixes are shared. Ids sit on the arcs, as near to the start as the words
through an arc allow. The finished automaton is a file of flat arrays that workers memory-map.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

Ids = tuple[int, ...]


class _State:
    __slots__ = ("arcs", "final", "rest")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # label -> [ids, state]
        self.final = False
        self.rest: Ids = ()  # ids given at the end of a word

    def signature(self) -> tuple:
        return (self.final, self.rest, tuple((b, ids, id(state)) for b, (ids, state) in self.arcs.items()))


def _shared(a: Ids, b: Ids) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def build(entries: Iterable[tuple[bytes, Ids]]) -> bytes:
    """The automaton of (word, ids) pairs, words distinct and sorted, as bytes for Transducer."""
    start = _State()
    register: dict[tuple, _State] = {}
    path = [start]  # the states of the word before
    before = b""

    def settle(depth: int) -> None:
        """Merge the states of the word before below depth with equal ones."""
        for i in range(len(path) - 1, depth, -1):
            state = register.setdefault(path[i].signature(), path[i])
            path[i - 1].arcs[before[i - 1]][1] = state
        del path[depth + 1 :]

    for word, ids in entries:
        if word <= before and before:
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        settle(same)
        for i in range(same):  # along the common path: keep the common ids, push the others down
            arc = path[i].arcs[word[i]]
            n = _shared(arc[0], ids)
            if extra := arc[0][n:]:
                arc[0] = arc[0][:n]
                below = arc[1]
                for other in below.arcs.values():
                    other[0] = extra + other[0]
                if below.final:
                    below.rest = extra + below.rest
            ids = ids[n:]
        for i in range(same, len(word)):
            path.append(_State())
            path[i].arcs[word[i]] = [ids if i == same else (), path[i + 1]]
        last = path[-1]
        last.final = True
        last.rest = ids if same == len(word) else ()
        before = word
    settle(0)
    return _pack(start)


def _pack(start: _State) -> bytes:
    order, numbers, todo = [], {id(start): 0}, [start]
    while todo:
        state = todo.pop()
        order.append(state)
        for _, below in state.arcs.values():
            if id(below) not in numbers:
                numbers[id(below)] = len(numbers)
                todo.append(below)
    order.sort(key=lambda s: numbers[id(s)])
    pool: dict[Ids, int] = {}
    keys, targets, outputs, rests = [], [], [], []
    for n, state in enumerate(order):
        rests.append(pool.setdefault(state.rest, len(pool)) if state.final else -1)
        for label, (ids, below) in sorted(state.arcs.items()):
            keys.append(n << 8 | label)
            targets.append(numbers[id(below)])
            outputs.append(pool.setdefault(ids, len(pool)))
    ends = np.cumsum([0, *(len(x) for x in pool)])
    arrays = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), np.array(rests, np.int32),
        ends.astype(np.int64), np.array([i for x in pool for i in x], np.int32),
    ]
    head = np.array([len(a) for a in arrays], np.int64)
    return b"".join([head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])


class Transducer:
    """Looks many words up at once in a memory-mapped automaton."""

    def __init__(self, buffer) -> None:
        head, at, arrays = np.frombuffer(buffer, np.int64, 6), 48, []
        for n, kind in zip(head.tolist(), (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32), strict=True):
            arrays.append(np.frombuffer(buffer, kind, n, at))
            at += arrays[-1].nbytes + -arrays[-1].nbytes % 8
        self.keys, self.targets, self.outputs, self.rests, self.ends, self.pool = arrays

    @classmethod
    def map(cls, path: str) -> Transducer:
        """Memory-map the file at path."""
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, ids, ids of each word): whether the lexicon has each word, and the ids of those it has."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        met: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(self.keys):
            alive = alive[lengths[alive] > depth]
            if not len(alive):
                break
            key = state[alive] << 8 | data[starts[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[arc] == key
            state[alive[~same]] = -1
            alive, arc = alive[same], arc[same]
            state[alive] = self.targets[arc]
            met.append((alive, self.outputs[arc]))
            depth += 1
        if not len(self.keys):
            state[lengths > 0] = -1
        rest = np.where(state >= 0, self.rests[state], -1)
        found = rest >= 0
        met.append((np.flatnonzero(found), rest[found]))
        row = np.concatenate([r for r, _ in met])
        given = np.concatenate([g for _, g in met])
        order = np.argsort(row, kind="stable")  # ids of a word in the order of its letters
        row, given = row[order], given[order]
        row, given = row[found[row]], given[found[row]]
        sizes = self.ends[given + 1] - self.ends[given]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.ends[given] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return found, ids, np.bincount(row, sizes, len(words)).astype(np.int64)
