"""Fits and running sums against dense NumPy versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayline.functions.hashing import hamming_hex64, hash_keys
from bayline.operators import dedupe, fits, running


def data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 2, 0.5]
    y = rng.random(n) < 1 / (1 + np.exp(-(0.4 + x @ [1.2, -0.7, 0.3])))
    fold = rng.integers(0, 3, n)
    return x, y, fold


@pytest.fixture(scope="module")
def rows(spark):
    x, y, fold = data()
    out = [(*map(float, a), bool(b), int(f), i) for i, (a, b, f) in enumerate(zip(x, y, fold, strict=True))]
    out += [(None, 1.0, 1.0, True, 0, -1), (1.0, float("nan"), 1.0, True, 0, -2), (1.0, 1.0, 1.0, None, 0, -3)]
    return spark.createDataFrame(out, "a double, b double, c double, label boolean, fold int, id long").repartition(4)


def newton(x, y, penalty, slope, curvature, weight=None):
    design, v = np.column_stack([np.ones(len(x)), x]), np.ones(len(x)) if weight is None else weight
    w, ridge = np.zeros(design.shape[1]), np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(60):
        z = design @ w
        w = w - np.linalg.solve(design.T @ (design * (v * curvature(z, y))[:, None]) + ridge, design.T @ (v * slope(z, y)) + ridge @ w)
    return w


def plain_logistic(x, y, penalty):
    q = lambda z: 1 / (1 + np.exp(-z))
    return newton(x, y, penalty, lambda z, y: q(z) - y, lambda z, y: q(z) * (1 - q(z)))


def test_logistic_weights(rows):
    x, y, fold = data()
    fit = fits.logistic_fit(rows, ["a", "b", "c"], "label")
    assert fit.converged and [fit.intercept, *fit.weights] == pytest.approx(plain_logistic(x, y, 1.0), abs=1e-7)
    held = fits.out_of_fold(rows, ["a", "b", "c"], "label", "fold", [0, 1, 2], penalty=0.5)
    for k, f in held.items():
        assert [f.intercept, *f.weights] == pytest.approx(plain_logistic(x[fold != k], y[fold != k], 0.5), abs=1e-7)
    short = fits.logistic_fit(rows, ["a", "b", "c"], "label", most=2)
    assert not short.converged and short.steps == 2


def test_a_flat_feature_and_no_rows_are_no_error(rows):
    fit = fits.logistic_fit(rows.withColumn("flat", F.lit(0.0)), ["a", "flat"], "label", penalty=0.0)
    assert fit.converged and fit.named()["flat"] == 0
    none = fits.logistic_fit(rows.limit(0), ["a"], "label")
    assert none.weights == (0.0,) and none.intercept == 0


def test_margins_and_their_calibration(rows, spark):
    x, y, fold = data()
    side = 2.0 * y - 1
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    known = rows.where("id >= 0")
    plain = newton(x, y, 1.0, lambda z, y: -2 * side * np.maximum(1 - side * z, 0), lambda z, y: np.where(side * z < 1, 2.0, 0.0), weight)
    margin, sigmoid = fits.calibrated_margin_fit(known, ["a", "b", "c"], "label", "fold", [0, 1, 2])
    assert margin.converged and [margin.intercept, *margin.weights] == pytest.approx(plain, abs=1e-6)
    assert sigmoid.converged and sigmoid.weights[0] > 0
    scored = known.select(margin.margin().alias("margin"), "label").select(F.when(sigmoid.margin() > 0, 1).otherwise(0).alias("p"), F.col("label").cast("int").alias("y"))
    assert scored.where("p = y").count() > 0.7 * len(y)


def test_samples_lie_inside_one_another(rows):
    found = {}
    for r in fits.nested_samples(rows, "id", [0.1, 0.4, 1.0]).collect():
        found.setdefault(r.share, set()).add(r.id)
    assert found[0.1] < found[0.4] < found[1.0] and len(found[1.0]) == 603


@pytest.mark.parametrize("scale", [0.1, 1.0, 2.5, 60.0])
def test_temperature(spark, scale):
    rng = np.random.default_rng(5)
    z = rng.normal(size=500) * 2
    y = rng.random(500) < 1 / (1 + np.exp(-z))
    found = fits.temperature(spark.createDataFrame([(float(a * scale), bool(b)) for a, b in zip(z, y, strict=True)] + [(None, True)], "z double, y boolean"), "z", "y")
    slope = lambda b: float((z * scale * (1 / (1 + np.exp(-np.clip(b * z * scale, -700, 700))) - y)).sum())
    low, high = 0.25, 4.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    expected = 4.0 if slope(0.25) >= 0 else 0.25 if slope(4.0) <= 0 else 1 / low
    assert found == pytest.approx(expected, abs=1e-6) and 0.25 <= found <= 4
    assert fits.temperature(spark.createDataFrame([], "z double, y boolean"), "z", "y") == 1.0


def test_running_sums_and_precision(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), None if i % 60 == 0 else rng.randrange(50) / 50, rng.random() < 0.5) for i in range(900)]
    truths = {"a": 300, "b": 700, "c": 4, "d": 0}
    df = spark.createDataFrame(rows, "g string, score double, hit boolean").repartition(5)
    found = {r.g: r.ap for r in running.average_precision(df, spark.createDataFrame(list(truths.items()), "g string, truths long"), ["g"]).collect()}
    for g in "ab":
        own = [(-math.inf if s is None else s, h) for x, s, h in rows if x == g]
        points = []
        for at in sorted({s for s, _ in own}, reverse=True):
            hits = [h for s, h in own if s >= at]
            points.append((sum(hits), sum(hits) / len(hits)))
        ap, before = 0.0, 0
        for i, (tp, _) in enumerate(points):
            ap += (tp - before) / truths[g] * max(p for _, p in points[i:])
            before = tp
        assert found[g] == pytest.approx(ap)
    assert found["c"] == 0 and "d" not in found


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_keys_miss_no_near_hash(spark, most):
    rng = random.Random(most)
    hashes = {rng.getrandbits(64) for _ in range(30)}
    for h in list(hashes):
        for _ in range(5):
            near = h
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                near ^= 1 << bit
            hashes.add(near)
    texts = [f"{h:016x}" for h in hashes]
    plain = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in texts for b in texts if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= most}
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:9], None, "xyz"]], "h string")
    assert {tuple(r) for r in dedupe.near_hashes(df, "h", most).collect()} == plain
    keys = df.where("length(h) = 16").select(F.size(hash_keys(F.col("h"), most)).alias("n"), hamming_hex64(F.col("h"), F.col("h")).alias("d")).distinct().collect()
    assert keys[0].n == math.comb(2 * most, most) and keys[0].d == 0


def test_joined_pairs_grow_with_the_rows(spark):
    """Ten times the random hashes meet about a hundred times in bands of 16 bits, but hardly ever in these keys."""
    rng = random.Random(9)
    df = spark.createDataFrame([(f"{rng.getrandbits(64):016x}",) for _ in range(3000)], "h string")
    keyed = dedupe._keyed(df, "h", 3)
    assert keyed.groupBy("band", "value").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0))).first()[0] < 300


def test_hashes_that_share_a_half_do_not_all_meet(spark):
    """Texts of common words have hashes with equal halves; keys for one bit had just these halves, so all pairs of them met."""
    rng = random.Random(6)
    hashes = [f"{7 << 32 | rng.getrandbits(32):016x}" for _ in range(600)]
    hashes += [f"{int(h, 16) ^ 1 << rng.randrange(64):016x}" for h in hashes[:100]]
    df = spark.createDataFrame([(h,) for h in [*hashes, "F" * 16, "f" * 15 + "e"]], "h string")
    assert dedupe._keyed(df, "h", 1).groupBy("band", "value").count().agg(F.max("count")).first()[0] <= 16
    pairs = lambda most: {(a, b, d) for a in hashes for b in hashes if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= most}
    assert {tuple(r) for r in dedupe.near_hashes(df, "h", 1).collect()} == pairs(1) | {("F" * 16, "f" * 15 + "e", 1)}
    near = dedupe.hashes_near(df.limit(600), df.where("h like 'F%'").union(spark.createDataFrame([(hashes[0],)], "h string")), "h", 3).collect()
    assert {r.h for r in near} == {h for h in hashes[:600] if (int(h, 16) ^ int(hashes[0], 16)).bit_count() <= 3}


def test_folds_of_calibrated_margins_share_each_pass(spark, monkeypatch):
    """The same fits as fold by fold, in about as many passes as the slowest of them takes."""
    rng = random.Random(4)
    rows = [(x := rng.gauss(0, 1), rng.gauss(0, 1), x + rng.gauss(0, 1) > 0, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, label boolean, fold int")
    passes, sums = [], fits._sums
    monkeypatch.setattr(fits, "_sums", lambda r, models, *rest: passes.append(len(models)) or sums(r, models, *rest))
    margin, sigmoid = fits.calibrated_margin_fit(df, ["a", "b"], "label", "fold", [0, 1, 2])
    shared = len(passes)
    weighted = fits.balanced_weights(df, "label")
    alone = [fits.margin_fit(weighted.where(f"fold <> {k}"), ["a", "b"], "label", weight="weight") for k in range(4)]
    assert max(abs(x - y) for x, y in zip(margin.weights, alone[3].weights, strict=True)) < 1e-9
    unseen = None
    for k in range(3):
        part = weighted.where(f"fold = {k}").select(alone[k].margin().alias("margin"), "label")
        unseen = part if unseen is None else unseen.unionByName(part)
    plain = fits.logistic_fit(unseen, ["margin"], "label", penalty=0.0)
    assert abs(sigmoid.intercept - plain.intercept) < 1e-7 and abs(sigmoid.weights[0] - plain.weights[0]) < 1e-7
    assert shared == max(f.steps for f in alone) + sigmoid.steps and passes[0] == 4
