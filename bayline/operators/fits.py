"""Fits by passes over the rows: logistic regression, calibrated margins, temperature.

A step of a fit is one aggregate whose size depends on the number of features and folds alone; the
driver solves the small system that comes out of it. Rows never leave the executors. Rows that lack
the label, the weight or a feature take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.functions.numbers import sigmoid

#: Points between the bracket's ends that one pass of the temperature looks at.
POINTS = 15
#: A fold that no row is in: the fit outside it is that of all rows.
WHOLE = -(1 << 31)


@dataclass(frozen=True)
class Fit:
    """Weights by feature, the intercept apart; converged tells whether the last step was below the tolerance."""

    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]
    converged: bool
    steps: int

    def margin(self) -> Column:
        """The linear score of a row."""
        return sum((F.lit(w) * F.col(c).cast("double") for c, w in zip(self.features, self.weights, strict=True)), F.lit(self.intercept))

    def named(self) -> dict[str, float]:
        """Weights by name, with the intercept."""
        return {"intercept": self.intercept} | dict(zip(self.features, self.weights, strict=True))


def _prepared(rows: DataFrame, features: list[str], label: str, weight: str | None, fold: str | None) -> DataFrame:
    xs = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in features))
    out = rows.select(
        xs.alias("x"), F.col(label).cast("int").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("v"), (F.col(fold) if fold else F.lit(None).cast("int")).alias("fold")
    )
    return out.where(F.col("y").isNotNull() & F.col("v").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e)))


def _sums(rows: DataFrame, models: dict, size: int, slope, curvature) -> dict:
    """Gradient and Hessian of each model over the rows outside its fold, in one pass.

    slope and curvature give the loss's derivatives by the margin, from margin and label.
    """
    each = F.array(*(F.struct(F.lit(k).alias("model"), F.array(*map(F.lit, map(float, w))).alias("w")) for k, w in models.items()))
    spread = rows.select("x", "y", "v", "fold", F.explode(each).alias("m")).where(F.col("fold").isNull() | (F.col("fold") != F.col("m.model")))
    z = sum((F.col("x")[i] * F.col("m.w")[i] for i in range(size)), F.lit(0.0))
    scored = spread.select("x", F.col("m.model").alias("model"), (slope(z, F.col("y")) * F.col("v")).alias("g"), (curvature(z, F.col("y")) * F.col("v")).alias("h"))
    parts = [F.sum(F.col("g") * F.col("x")[i]).alias(f"g{i}") for i in range(size)]
    parts += [F.sum(F.col("h") * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i in range(size) for j in range(i + 1)]
    out = {}
    for r in scored.groupBy("model").agg(*parts).collect():  # one row for each model
        hessian = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)])
        out[r["model"]] = np.array([r[f"g{i}"] for i in range(size)]), hessian
    return out


def _newton(rows: DataFrame, features: list[str], models: list, penalty: float, tolerance: float, most: int, slope, curvature) -> dict:
    size = len(features) + 1
    weights = {k: np.zeros(size) for k in models}
    steps, left = dict.fromkeys(models, 0), set(models)
    ridge = np.diag([0.0] + [penalty] * len(features))
    for _ in range(most):
        for k, (gradient, hessian) in _sums(rows, {k: weights[k] for k in sorted(left)}, size, slope, curvature).items():
            # a feature that never varies leaves its row of the Hessian flat: the least step solves it
            step = np.linalg.lstsq(hessian + ridge, gradient + ridge @ weights[k], rcond=None)[0]
            weights[k] = weights[k] - step
            steps[k] += 1
            if np.abs(step).max() < tolerance:
                left.discard(k)
        if not left:
            break
    return {k: Fit(tuple(features), float(w[0]), tuple(map(float, w[1:])), k not in left, steps[k]) for k, w in weights.items()}


def logistic_fit(rows: DataFrame, features: list[str], label: str, penalty: float = 1.0, weight: str | None = None, tolerance: float = 1e-9, most: int = 50) -> Fit:
    """The weights that minimise the log-loss plus penalty / 2 times their squares, the intercept's apart, by Newton's method."""
    return out_of_fold(rows, features, label, None, [0], penalty, weight, tolerance, most)[0]


def out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str | None, folds: list[int], penalty: float = 1.0, weight: str | None = None, tolerance: float = 1e-9, most: int = 50) -> dict[int, Fit]:
    """For each fold the fit to the rows outside it; all folds share each pass."""
    prepared = _prepared(rows, features, label, weight, fold)
    return _newton(prepared, features, folds, penalty, tolerance, most, lambda z, y: sigmoid(z) - y, lambda z, y: sigmoid(z) * (1 - sigmoid(z)))


def margin_fit(rows: DataFrame, features: list[str], label: str, penalty: float = 1.0, weight: str | None = None, tolerance: float = 1e-9, most: int = 50) -> Fit:
    """A linear support-vector fit with the squared hinge loss, by Newton steps over the rows inside the margin."""
    return margins_out_of_fold(rows, features, label, None, [0], penalty, weight, tolerance, most)[0]


def margins_out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str | None, folds: list[int], penalty: float = 1.0, weight: str | None = None, tolerance: float = 1e-9, most: int = 50) -> dict[int, Fit]:
    """For each fold the margin fit to the rows outside it; all folds share each pass."""
    prepared = _prepared(rows, features, label, weight, fold)
    side = lambda y: 2 * y - 1
    short = lambda z, y: F.greatest(1 - side(y) * z, F.lit(0.0))
    return _newton(prepared, features, folds, penalty, tolerance, most, lambda z, y: -2 * side(y) * short(z, y), lambda z, y: F.when(side(y) * z < 1, 2.0).otherwise(0.0))


def balanced_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """rows with a weight that gives both labels the same total: n / (2 * n of the label)."""
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n")).where("__label is not null").collect()  # two rows
    total = sum(r["__n"] for r in counts)
    weight = F.lit(None).cast("double")
    for r in counts:
        weight = F.when(F.col(label) == F.lit(r["__label"]), total / (len(counts) * r["__n"])).otherwise(weight)
    return rows.withColumn(name, weight)


def calibrated_margin_fit(rows: DataFrame, features: list[str], label: str, fold: str, folds: list[int], penalty: float = 1.0) -> tuple[Fit, Fit]:
    """(margin fit, sigmoid of its margins): a balanced support-vector fit whose margins are turned into probabilities.

    The sigmoid is fitted to margins of rows that their fold's fit has not seen. The folds' fits and
    that of all rows share each pass. Rows without a fold train every fit and are no fold's unseen rows.
    """
    weighted = balanced_weights(rows, label, "__weight")
    found = margins_out_of_fold(weighted, features, label, fold, [*folds, WHOLE], penalty, "__weight")
    margin = F.lit(None).cast("double")
    for k in folds:
        margin = F.when(F.col(fold) == k, found[k].margin()).otherwise(margin)
    return found[WHOLE], logistic_fit(weighted.select(margin.alias("margin"), F.col(label)), ["margin"], label, penalty=0.0)


def nested_samples(rows: DataFrame, key: str, shares: list[float], seed: int = 0) -> DataFrame:
    """rows once for each share, of those whose hash lies below it: smaller samples lie inside larger ones."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return rows.withColumn("share", F.explode(F.filter(F.array(*map(F.lit, shares)), lambda s: place < s)))


def temperature(rows: DataFrame, logit: str, label: str, low: float = 0.25, high: float = 4.0, tolerance: float = 1e-9) -> float:
    """The temperature in [low, high] by which logits are divided for the least log-loss.

    The loss is convex in the inverse temperature, so its slope changes sign once: every pass looks
    at POINTS points of the bracket and keeps the interval where it does. Without rows it is 1.
    """
    known = rows.select(F.col(logit).cast("double").alias("z"), F.col(label).cast("int").alias("y")).dropna()
    a, b = 1 / high, 1 / low

    def slopes(points: list[float]) -> list[float | None]:
        return list(known.agg(*(F.sum(F.col("z") * (sigmoid(F.col("z") * p) - F.col("y"))).alias(f"s{i}") for i, p in enumerate(points))).first())

    first, last = slopes([a, b])
    if first is None:
        return 1.0
    if first >= 0:
        return high
    if last <= 0:
        return low
    while b - a > tolerance:
        points = [a + (b - a) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        below = [p for p, s in zip(points, slopes(points), strict=True) if s < 0]
        a, b = max(below, default=a), min((p for p in points if p not in below), default=b)
    return 2 / (a + b)
