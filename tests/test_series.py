"""The smoother over series that are cut into ranges."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from bayline.operators import series, temporal


@contextlib.contextmanager
def many_ranges(spark, n):
    names = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def readings(seed):
    """One series with most rows, short ones, rows without a value, a series without any, times that tie, a null slot."""
    rng = random.Random(seed)
    level, out = 0.5, []
    for i in range(400):
        level = min(1.0, max(0.0, level + rng.uniform(-0.25, 0.25)))
        out.append((7, i // 2, i, None if rng.random() < 0.1 else float("nan") if rng.random() < 0.03 else level, rng.random() < 0.5, f"d{i % 3}"))
    out += [(s, t, 1000 + 100 * s + t, rng.random(), rng.random() < 0.5, "d0") for s in range(5) for t in range(rng.randint(1, 12))]
    out += [(8, t, 3000 + t, None, True, None) for t in range(20)] + [(None, t, 4000 + t, rng.random(), None, None) for t in range(9)]
    rng.shuffle(out)
    return out


SCHEMA = "slot long, at long, id long, p double, truth boolean, dataset string"


def plain(rows, how):
    """id to (ema, state, changed) by one walk of each series."""
    out = {}
    for slot in {r[0] for r in rows}:
        tracker, seen = temporal.SlotState(), (None, False)
        for r in sorted((r for r in rows if r[0] == slot), key=lambda r: (r[1], r[2])):
            if r[3] is None or r[3] != r[3]:
                out[r[2]] = (*seen, False)
            else:
                out[r[2]] = tracker.update(r[3], how)
                seen = out[r[2]][:2]
    return out


@pytest.mark.parametrize("how", [temporal.Smoothing(), temporal.Smoothing(window=1, persistence=1), temporal.Smoothing(window=5, alpha=0.7, hysteresis=0.04, persistence=3)])
def test_ranges_of_a_series_join_up(spark, how):
    rows = readings(how.window)
    with many_ranges(spark, 40):
        df = spark.createDataFrame(rows, SCHEMA)
        out = temporal.smooth(df, "slot", "at", "p", how, keep=["id"], then=["id"])
        found = {r.id: (r.ema, r.state, r.changed) for r in out.collect()}
        ranged = series.in_ranges(df, ["slot"], [F.col("at"), F.col("id")])
        crossed = ranged.where("slot = 7").select(series.PART).distinct().count()
    expected = plain(rows, how)
    assert crossed > 10 and set(found) == set(expected) and any(e[2] for e in expected.values())
    for i, (ema, state, changed) in expected.items():
        assert found[i][1:] == (state, changed)
        assert found[i][0] == (None if ema is None else pytest.approx(ema, abs=1e-12))


def test_grid_over_ranges(spark):
    rows = readings(4)
    with many_ranges(spark, 40):
        found = temporal.smooth_grid(spark.createDataFrame(rows, SCHEMA), "slot", "at", "p", "truth", "dataset", then=["id"]).collect()
    known = sorted((r for r in rows if r[3] is not None and r[3] == r[3]), key=lambda r: (r[1], r[2]))
    truth = {r[2]: bool(r[4]) for r in known}
    changes = lambda x: sum(a != b for a, b in zip(x, x[1:], strict=False))
    for k in (0, 13, 44, 80):
        states = {i: s for i, (_, s, _) in plain(rows, temporal.GRID[k]).items()}
        expected = {}
        for r in known:
            name = ("tp" if truth[r[2]] else "fp") if states[r[2]] else ("fn" if truth[r[2]] else "tn")
            expected[r[0], r[5], name] = expected.get((r[0], r[5], name), 0) + 1
        mine = [r for r in found if r.setting == k]
        assert {(r.slot, r.dataset, c): r[c] for r in mine for c in ("tp", "tn", "fp", "fn") if r[c]} == expected
        for slot in {r[0] for r in known}:
            ids = [r[2] for r in known if r[0] == slot]
            off = abs(changes([states[i] for i in ids]) - changes([truth[i] for i in ids]))
            assert sum(r.transition_error for r in mine if r.slot == slot) == off


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert temporal.smooth(df, "slot", "at", "p").collect() == [] and temporal.smooth_grid(df, "slot", "at", "p", "truth", "dataset").collect() == []


def test_a_task_never_holds_a_series(spark):
    df = spark.createDataFrame(readings(5), SCHEMA)
    plan = temporal.smooth(df, "slot", "at", "p")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan and "Window" not in plan
