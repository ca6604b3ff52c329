"""The smoother as a stream: one state for each slot, events as they happen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bayline.operators.temporal import SlotState, Smoothing

STATE = "recent array<double>, ema double, state boolean, pending int, last long"
OUTPUT = "slot long, at long, ema double, state boolean, changed boolean"


def smooth_stream(readings: DataFrame, slot: str, at: str, p: str, how: Smoothing = Smoothing()) -> DataFrame:
    """The streaming twin of temporal.smooth().

    Each slot's readings must come in order from one micro-batch to the next; inside a batch they
    are sorted. A reading no later than the last one seen was counted already and is dropped, so a
    replayed batch changes nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, ema, on, pending, last = state.get if state.exists else ([], None, False, 0, None)
        tracker = SlotState(list(recent), ema, on, pending)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for moment, value in zip(rows["at"].tolist(), rows["p"].tolist(), strict=True):
            if last is None or moment > last:
                out.append((key[0], moment, *tracker.update(value, how)))
                last = moment
        state.update((tracker.recent, tracker.ema, bool(tracker.state), tracker.pending, last))
        yield pd.DataFrame(out, columns=["slot", "at", "ema", "state", "changed"])

    named = readings.select(F.col(slot).cast("long").alias("slot"), F.col(at).cast("long").alias("at"), F.col(p).cast("double").alias("p"))
    return named.groupBy("slot").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(readings: DataFrame, ts: str, camera: str, occupied: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Readings and occupied ones of each camera and window; rows later than the watermark are dropped."""
    counted = readings.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    windows = counted.groupBy(F.window("__ts", every).alias("w"), camera).agg(F.count("*").alias("readings"), F.count_if(occupied).alias("occupied"))
    return windows.select(F.col("w.start").alias("start"), camera, "readings", "occupied")
