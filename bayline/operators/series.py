"""The smoother over series of any length.

Rows are dealt to ranges of (slot, order), so a long series lies in several. Tasks walk their ranges
batch by batch and hold one reading's state. What a series brings into a range is worked out from
one summary a range: its mean over a range is an affine map of the mean before it, and its verdict
a map of the few (state, pending) pairs. The driver chains these summaries, at most two for a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bayline.operators.running import PART, in_ranges

if TYPE_CHECKING:
    from bayline.operators.temporal import Smoothing


class Carry(NamedTuple):
    """What a series brings along: last values, a mean for each (window, alpha), a mode for each setting, last truth."""

    recent: np.ndarray
    ema: dict[tuple[int, float], float | None]
    mode: list[int | None]
    truth: bool | None = None


def medians(values: np.ndarray, recent: np.ndarray, window: int) -> np.ndarray:
    """Median of each value and the up to window - 1 before it, recent being those before the first."""
    before = recent[max(0, len(recent) - window + 1) :]
    joined = np.concatenate([before, values])
    short = [np.median(joined[: i + 1]) for i in range(len(before), min(window - 1, len(joined)))]
    if len(joined) < window:
        return np.array(short, float)
    full = np.median(np.lib.stride_tricks.sliding_window_view(joined, window), axis=1)
    return np.concatenate([short, full])


def means(values: np.ndarray, ema: float | None, alpha: float) -> np.ndarray:
    """The exponential mean after each value; without one before, the first value is its own."""
    if ema is None:
        steps = accumulate(values.tolist(), lambda e, v: (1 - alpha) * e + alpha * v)
    else:
        steps = accumulate(values.tolist(), lambda e, v: (1 - alpha) * e + alpha * v, initial=ema)
        next(steps)
    return np.fromiter(steps, float)


def verdicts(ema: np.ndarray, mode: int | None, how: Smoothing) -> tuple[np.ndarray, int | None]:
    """The state after each mean, and the mode: state * persistence + number of means that ask for a change."""
    if not len(ema):
        return np.empty(0, bool), mode
    states: list[bool] = []
    if mode is None:
        state, pending = bool(ema[0] >= how.threshold), 0
        states.append(state)
    else:
        state, pending = bool(mode // how.persistence), mode % how.persistence
    rest = ema[len(states) :]
    for up, down in zip((rest >= how.threshold + how.hysteresis).tolist(), (rest <= how.threshold - how.hysteresis).tolist(), strict=True):
        pending = pending + 1 if (down if state else up) else 0
        if pending >= how.persistence:
            state, pending = not state, 0
        states.append(state)
    return np.array(states, bool), state * how.persistence + pending


class Walk:
    """Several settings over the same series."""

    def __init__(self, settings: Sequence[Smoothing]) -> None:
        self.settings = list(settings)
        self.combos = sorted({(s.window, s.alpha) for s in self.settings})
        self.memory = max(max(s.window for s in self.settings) - 1, 1)
        self.start = Carry(np.empty(0), dict.fromkeys(self.combos), [None] * len(self.settings))

    def last(self, recent: np.ndarray, values: np.ndarray) -> np.ndarray:
        joined = np.concatenate([recent, values[-self.memory :]])
        return joined[-self.memory :]

    def means(self, values: np.ndarray, carry: Carry) -> tuple[dict[tuple[int, float], np.ndarray], Carry]:
        """Means of each (window, alpha) after each value, and what the series brings along then."""
        middle = {w: medians(values, carry.recent, w) for w in {w for w, _ in self.combos}}
        found = {(w, a): means(middle[w], carry.ema[w, a], a) for w, a in self.combos}
        ema = {c: float(e[-1]) if len(e) else carry.ema[c] for c, e in found.items()}
        return found, carry._replace(recent=self.last(carry.recent, values), ema=ema)

    def states(self, found: dict, carry: Carry) -> tuple[list[np.ndarray], Carry]:
        """States of each setting after each value."""
        steps = [verdicts(found[s.window, s.alpha], m, s) for s, m in zip(self.settings, carry.mode, strict=True)]
        return [s for s, _ in steps], carry._replace(mode=[m for _, m in steps])


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of one range and slot in a batch, each with (range, slot)."""
    ends = sorted({e for c in (PART, "slot") for e in pc.run_end_encode(batch[c]).run_ends.to_pylist()})
    low = 0
    for high in ends:
        yield (batch[PART][low].as_py(), batch["slot"][low].as_py()), batch.slice(low, high - low)
        low = high


def readings(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a value, and those values; NaN counts as none."""
    p = piece["p"].to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(p)
    return known, p[known]


def in_order(ranged: DataFrame, order: Sequence[str]) -> DataFrame:
    """Whole ranges to a task, sorted there (by spilling where need be)."""
    return ranged.repartition(PART).sortWithinPartitions(PART, "slot", *order)


def folded(rows: DataFrame, new: Callable, take: Callable, result: Callable, schema: str) -> DataFrame:
    """One row for each range and slot of sorted rows: take(state, piece) from new(range, slot) on, then result(state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for own, piece in pieces(batch):
                if own != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([result(key, state)], schema=arrow)
                    key, state = own, new(own)
                state = take(state, piece)
        if key is not None:
            yield pa.RecordBatch.from_pylist([result(key, state)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def carries(ranged: DataFrame, order: Sequence[str], walk: Walk) -> dict[tuple, Carry]:
    """What each series that goes over a range's border brings into its ranges, by (range, slot)."""
    ends = ranged.groupBy(PART).agg(F.min(F.struct("slot")).alias("a"), F.max(F.struct("slot")).alias("b")).orderBy(PART).collect()
    crossing = {(r.b.slot,) for r, s in zip(ends, ends[1:], strict=False) if r.b.slot == s.a.slot}
    if not crossing:
        return {}
    wanted = F.broadcast(ranged.sparkSession.createDataFrame(sorted(crossing, key=repr), "__slot long"))
    narrow = ranged.select(PART, "slot", *order, "truth").join(wanted, F.col("slot").eqNullSafe(F.col("__slot")), "left_semi")
    rows = in_order(narrow, order)
    size = walk.memory

    def first(key: tuple) -> tuple:
        return 0, np.empty(0), np.empty(0), [1.0] * len(walk.combos), [0.0] * len(walk.combos), None

    def summarise(state: tuple, piece: pa.RecordBatch) -> tuple:
        n, head, tail, factor, shift, _ = state
        _, values = readings(piece)
        skipped = max(0, size - n)
        for i, (w, a) in enumerate(walk.combos):
            beyond = medians(values, tail, w)[skipped:]
            if len(beyond):
                factor[i] *= (1 - a) ** len(beyond)
                shift[i] = float(means(beyond, shift[i], a)[-1])
        truth = piece["truth"][len(piece) - 1].as_py()
        return n + len(values), np.concatenate([head, values[:skipped]]), walk.last(tail, values), factor, shift, truth

    summary = folded(
        rows, first, summarise,
        lambda key, s: {"part": key[0], "slot": key[1], "n": s[0], "head": s[1].tolist(), "tail": s[2].tolist(), "factor": s[3], "shift": s[4], "truth": s[5]},
        "part int, slot long, n long, head array<double>, tail array<double>, factor array<double>, shift array<double>, truth boolean",
    )
    out: dict[tuple, Carry] = {}
    series: dict = {}
    for r in sorted(summary.collect(), key=lambda r: r.part):
        out[r.part, r.slot] = carry = series.get(r.slot, walk.start)
        _, after = walk.means(np.array(r.head, float), carry)
        if r.n > len(r.head):
            ema = {c: f * after.ema[c] + s for c, f, s in zip(walk.combos, r.factor, r.shift, strict=True)}
            after = after._replace(ema=ema, recent=np.array(r.tail, float))
        series[r.slot] = after._replace(truth=r.truth)

    def begin(key: tuple) -> tuple:
        return out[key], [[None if v is None else k for k in range(2 * s.persistence)] for s in walk.settings for v in [out[key].ema[s.window, s.alpha]]]

    def advance(state: tuple, piece: pa.RecordBatch) -> tuple:
        carry, modes = state
        found, carry = walk.means(readings(piece)[1], carry)
        for k, s in enumerate(walk.settings):
            ema = found[s.window, s.alpha]
            for at in range(0, len(ema), 256):  # starts soon meet in one mode
                stepped = {m: verdicts(ema[at : at + 256], m, s)[1] for m in set(modes[k])}
                modes[k] = [stepped[m] for m in modes[k]]
        return carry, modes

    maps = folded(rows, begin, advance, lambda key, s: {"part": key[0], "slot": key[1], "modes": s[1]}, "part int, slot long, modes array<array<int>>")
    modes: dict = {}
    for r in sorted(maps.collect(), key=lambda r: r.part):
        before = modes.get(r.slot, walk.start.mode)
        out[r.part, r.slot] = out[r.part, r.slot]._replace(mode=before)
        modes[r.slot] = [m[b or 0] for m, b in zip(r.modes, before, strict=True)]
    return out


def walked(rows: DataFrame, order: Sequence[str], settings: Sequence[Smoothing], emit: Callable, schema: object) -> DataFrame:
    """emit(walk, carry, piece) -> (record batch, carry) over every series of rows (slot, order, p, truth, others), in order."""
    walk, order = Walk(settings), [*order, "p"]
    ranged = in_ranges(rows, ["slot"], [F.col(c) for c in order])
    brought = carries(ranged, order, walk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry = None, walk.start
        for batch in batches:
            for own, piece in pieces(batch):
                if own != key:
                    key, carry = own, brought.get(own, walk.start)
                out, carry = emit(walk, carry, piece)
                yield out

    return in_order(ranged, order).mapInArrow(run, schema)
