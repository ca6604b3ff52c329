"""Track confirmation as a stream: the last frames of each camera as state, idle cameras forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bayline.operators.matching import EDGES, iou_matrix

STATE = "first long, last long, numbers array<long>, boxes array<array<double>>"
OUTPUT = "camera long, frame_no long, box_id long, confirmed boolean"


def confirm_stream(detections: DataFrame, camera: str, frame_no: str, at: float = 0.45, history: int = 3, required: int = 2, idle_ms: int = 600_000) -> DataFrame:
    """The streaming twin of matching.confirm_tracks(): (camera, frame_no, box_id, confirmed) as frames arrive.

    detections have box_id and box. The state of a camera is the boxes of its last history frames.
    Frames come in order from one micro-batch to the next; inside a batch they are sorted. A frame
    no later than the last one seen was counted already and is dropped, so a replayed batch changes
    nothing. A camera without a frame for idle_ms of processing time is forgotten and warms up anew.
    Timers keep a query busy with empty batches; one that shall end by itself needs
    spark.sql.streaming.noDataMicroBatches.enabled to be false.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nothing = pd.DataFrame({"camera": [], "frame_no": [], "box_id": [], "confirmed": []})
        if state.hasTimedOut:
            state.remove()
            yield nothing
            return
        first, last, numbers, flat = state.get if state.exists else (None, None, [], [])
        kept = [(n, np.array(b, float).reshape(-1, 4)) for n, b in zip(numbers, flat, strict=True)]
        rows, out = pd.concat(list(batches)).sort_values(["frame_no", "box_id"]), []
        for number, group in rows.groupby("frame_no"):
            number = int(number)
            if last is not None and number <= last:
                continue
            first, boxes = number if first is None else first, group[list(EDGES)].to_numpy(float)
            seen = np.ones(len(boxes), int)
            for n, earlier in kept:
                if n >= number - history:
                    seen += (iou_matrix(boxes, earlier) >= at).any(axis=1)
            confirmed = (seen >= required) | (number - first < required - 1)
            out.append(pd.DataFrame({"camera": key[0], "frame_no": number, "box_id": group["box_id"].to_numpy(), "confirmed": confirmed}))
            kept, last = [*kept, (number, boxes)][-history:], number
        state.update((first, last, [n for n, _ in kept], [b.reshape(-1).tolist() for _, b in kept]))
        state.setTimeoutDuration(idle_ms)
        yield pd.concat(out) if out else nothing

    edges = [F.col("box")[e].cast("double").alias(e) for e in EDGES]
    rows = detections.select(F.col(camera).cast("long").alias("camera"), F.col(frame_no).cast("long").alias("frame_no"), F.col("box_id").cast("long").alias("box_id"), *edges)
    return rows.groupBy("camera").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
