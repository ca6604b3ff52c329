"""Smoothing of per-slot probabilities over time: median, mean, hysteresis, events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bayline.operators import series


@dataclass(frozen=True)
class Smoothing:
    """Parameters of the smoother."""

    threshold: float = 0.5
    window: int = 3
    alpha: float = 0.4
    hysteresis: float = 0.08
    persistence: int = 2


def rolling_median(rows: DataFrame, slot: str, order: list[str], p: str, window: int, out: str = "median") -> DataFrame:
    """rows with the median of a slot's last window values."""
    frame = W.partitionBy(slot).orderBy(*order).rowsBetween(-(window - 1), 0)
    return rows.withColumn(out, F.percentile(p, 0.5).over(frame))


def fold(readings: Column, how: Smoothing) -> Column:
    """Smooth an array of structs (at, median) in order: array of (at, ema, state, changed)."""
    empty = F.array().cast("array<struct<at:long,ema:double,state:boolean,changed:boolean>>")
    start = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(False).alias("state"), F.lit(0).alias("pending"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a.ema.isNull()
        ema = F.when(first, x.median).otherwise((1 - how.alpha) * a.ema + how.alpha * x.median)
        rise = ~a.state & (ema >= how.threshold + how.hysteresis)
        fall = a.state & (ema <= how.threshold - how.hysteresis)
        want = rise | fall
        changed = ~first & want & (a.pending + 1 >= how.persistence)
        state = F.when(first, ema >= how.threshold).when(changed, ~a.state).otherwise(a.state)
        pending = F.when(~first & want & ~changed, a.pending + 1).otherwise(F.lit(0))
        row = F.struct(x.at.alias("at"), ema.alias("ema"), state.alias("state"), changed.alias("changed"))
        return F.struct(ema.alias("ema"), state.alias("state"), pending.alias("pending"), F.concat(a.out, F.array(row)).alias("out"))

    return F.aggregate(readings, start, step, lambda a: a.out)


def smooth(rows: DataFrame, slot: str, at: str, p: str, how: Smoothing = Smoothing(), keep: Sequence[str] = (), then: Sequence[str] = ()) -> DataFrame:
    """(slot, at, ema, state, changed) and the columns of keep: each slot's series after median, mean and hysteresis.

    Rows of one time go by the columns of then, which keep holds. A row without a value (null, NaN)
    has the mean and state before it (null and false at the start). A series of any length is cut
    into ranges, see series.py; its means are those of one walk up to rounding.
    """

    def emit(walk: series.Walk, carry: series.Carry, piece: pa.RecordBatch) -> tuple[pa.RecordBatch, series.Carry]:
        known, values = series.readings(piece)
        before = carry.ema[how.window, how.alpha]
        was = carry.mode[0] is not None and bool(carry.mode[0] // how.persistence)
        found, carry = walk.means(values, carry)
        (states,), after = walk.states(found, carry)
        moved = states != np.concatenate([[was], states[:-1]]) if len(states) else states
        if len(moved) and carry.mode[0] is None:
            moved[0] = False
        place = np.cumsum(known)
        ema = np.concatenate([[np.nan if before is None else before], found[how.window, how.alpha]])[place]
        changed = np.zeros(len(known), bool)
        changed[known] = moved
        columns = [piece["slot"], piece["at"], pa.array(ema, from_pandas=True), pa.array(np.concatenate([[was], states])[place]), pa.array(changed)]
        return pa.RecordBatch.from_arrays([*columns, *(piece[c] for c in keep)], names=["slot", "at", "ema", "state", "changed", *keep]), after

    named = rows.select(F.col(slot).cast("long").alias("slot"), F.col(at).alias("at"), F.col(p).cast("double").alias("p"), F.lit(None).cast("boolean").alias("truth"), *keep)
    schema = StructType([StructField("slot", LongType()), StructField("at", rows.schema[at].dataType), *StructType.fromDDL("ema double, state boolean, changed boolean"), *(rows.schema[c] for c in keep)])
    return series.walked(named, ["at", *then], [how], emit, schema).withColumnsRenamed({"slot": slot, "at": at})


#: The grid of the smoother's parameters: window, alpha, hysteresis, persistence.
GRID = [Smoothing(0.5, w, a, h, n) for w in (1, 3, 5) for a in (0.3, 0.5, 0.7) for h in (0.04, 0.08, 0.12) for n in (1, 2, 3)]


def smooth_grid(rows: DataFrame, slot: str, at: str, p: str, truth: str, dataset: str, grid: Sequence[Smoothing] = GRID, then: Sequence[str] = ()) -> DataFrame:
    """(slot, dataset, setting, tp, tn, fp, fn, transition_error): each slot's smoothed states under every setting against the truth.

    setting numbers the grid; transition_error, on one row of a slot and setting, is how far the
    number of changes is from the true one. All settings go through a series together, range by
    range (series.py). Rows without a value take no part; a missing truth is false. Rows of one time
    go by the columns of then.
    """

    def emit(walk: series.Walk, carry: series.Carry, piece: pa.RecordBatch) -> tuple[pa.RecordBatch, series.Carry]:
        true = piece["truth"].to_numpy(zero_copy_only=False).astype(bool)
        found, after = walk.means(series.readings(piece)[1], carry)
        states, after = walk.states(found, after)
        s = np.array(states).T
        was = s[:1] if carry.truth is None else np.array([[m // g.persistence for m, g in zip(carry.mode, grid, strict=True)]], bool)
        truths = np.concatenate([true[:1] if carry.truth is None else [carry.truth], true])
        off = np.abs(np.diff(np.concatenate([was, s]).astype(np.int8), axis=0)).sum(axis=0) - (truths[1:] != truths[:-1]).sum()
        coded = piece["dataset"].dictionary_encode(null_encoding="encode")
        which, t = coded.indices.to_numpy(), true[:, None]
        out = []
        for k in range(len(coded.dictionary)):
            mine = which == k
            counts = [(a & b)[mine].sum(axis=0) for a, b in ((s, t), (~s, ~t), (s, ~t), (~s, t))]
            name = coded.dictionary[k].as_py()
            own = [pa.array([v] * len(grid), kind) for v, kind in ((piece["slot"][0].as_py(), pa.int64()), (name, pa.string()))]
            out.append([*own, pa.array(np.arange(len(grid))), *(pa.array(c.astype(np.int64)) for c in counts), pa.array((off if k == 0 else np.zeros(len(grid))).astype(np.int64))])
        columns = [pa.concat_arrays(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["slot", "dataset", "setting", "tp", "tn", "fp", "fn", "off"]), after._replace(truth=bool(true[-1]))

    value = F.col(p).cast("double")
    named = rows.where(value.isNotNull() & ~F.isnan(value)).select(
        F.col(slot).cast("long").alias("slot"), F.col(at).alias("at"), value.alias("p"), F.coalesce(truth, F.lit(False)).alias("truth"), F.col(dataset).cast("string").alias("dataset"), *then
    )
    found = series.walked(named, ["at", *then], grid, emit, "slot long, dataset string, setting long, tp long, tn long, fp long, fn long, off long")
    whole = found.groupBy("slot", "dataset", "setting").agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn", "off")))
    own = W.partitionBy("slot", "setting")
    first = F.row_number().over(own.orderBy("dataset")) == 1
    error = F.when(first, F.abs(F.sum("off").over(own))).otherwise(F.lit(0).cast("long"))
    return whole.withColumn("transition_error", error).drop("off")


class SlotState:
    """What the smoother remembers of one slot."""

    def __init__(self, recent: list[float] | None = None, ema: float | None = None, state: bool = False, pending: int = 0) -> None:
        self.recent, self.ema, self.state, self.pending = recent or [], ema, state, pending

    def update(self, p: float, how: Smoothing) -> tuple[float, bool, bool]:
        """Take one probability: (ema, state, whether the state changed)."""
        self.recent = [*self.recent, p][-how.window :]
        median = float(np.median(self.recent))
        if self.ema is None:
            self.ema, self.state = median, median >= how.threshold
            return self.ema, self.state, False
        self.ema = (1 - how.alpha) * self.ema + how.alpha * median
        limit = how.threshold + (-how.hysteresis if self.state else how.hysteresis)
        wants = self.ema <= limit if self.state else self.ema >= limit
        self.pending = self.pending + 1 if wants else 0
        changed = self.pending >= how.persistence
        if changed:
            self.state, self.pending = not self.state, 0
        return self.ema, self.state, changed


def islands(rows: DataFrame, groups: list[str], value: str, tolerance: float, out: str = "island") -> DataFrame:
    """rows with a number for each run of values whose neighbours lie within tolerance."""
    w = W.partitionBy(*groups).orderBy(value)
    gap = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0))
    return rows.withColumn("__gap", gap).withColumn(out, F.sum("__gap").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("__gap")


def union_length(rows: DataFrame, groups: list[str], low: str, high: str, out: str = "covered") -> DataFrame:
    """Per group the length that its intervals cover together."""
    before = W.partitionBy(*groups).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(high).over(before)
    own = F.greatest(F.col(high) - F.greatest(F.coalesce(reach, F.col(low)), F.col(low)), F.lit(0.0))
    return rows.withColumn("__own", own).groupBy(*groups).agg(F.sum("__own").alias(out))
