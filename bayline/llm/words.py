"""Separator-normalised texts: lower-cased words of letters, digits and non-ASCII bytes, one space between."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from bayline.llm.hashing import LOWER

WORD = np.zeros(256, bool)
WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


@dataclass
class Normalised:
    """The words of some texts; word i is data[start[i]:end[i]], and one space follows it."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # text t has the words bounds[t]:bounds[t + 1]
    source: np.ndarray  # where each word starts in the texts' own bytes

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) word of each run of n words inside a text, in order."""
        first = np.arange(len(self.start) - n + 1) if len(self.start) >= n else np.empty(0, np.int64)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        first = first[text[first] == text[first + n - 1]]
        return first, first + n - 1


def normalised(data: np.ndarray, offsets: np.ndarray) -> Normalised:
    """The texts data[offsets[i]:offsets[i + 1]] with A-Z lower-cased, word by word.

    Words are runs of 0-9, a-z and bytes from 0x80; a text's end ends a word.
    """
    data = LOWER[data]
    inside = WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    first[begins] = inside[begins]
    ends = begins[begins > 0] - 1
    last[ends] = inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = e - s
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(start[-1]), 0x20, np.uint8)
    spaced = np.ones(len(out), bool)
    spaced[start[1:] - 1] = False
    out[spaced] = data[inside]
    return Normalised(out, start[:-1], start[:-1] + sizes, np.searchsorted(s, offsets), s)
