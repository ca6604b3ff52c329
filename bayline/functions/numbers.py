"""Numeric column helpers: ratios, clamps, log-odds, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b; zero where b is zero or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ratio_floor_one(a: Column, b: Column) -> Column:
    """a over b or 1, whichever is more."""
    return a / F.greatest(b, F.lit(1))


def clamp_unit(x: Column, digits: int = 6) -> Column:
    """x held in [0, 1] and rounded."""
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), digits)


def logit(p: Column) -> Column:
    """Log-odds of a probability kept EPSILON away from 0 and 1."""
    held = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.ln(held / (F.lit(1.0) - held))


def sigmoid(x: Column) -> Column:
    """Logistic function of x held in [-40, 40]; null for null."""
    return F.when(x.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0)))))


def tempered_sigmoid(logits: Column, temperature: Column) -> Column:
    """Logistic function of logits over a temperature."""
    return sigmoid(logits / temperature)


def confidence(p: Column) -> Column:
    """The larger of p and 1 - p."""
    return F.greatest(p, F.lit(1.0) - p)


def grid(low: float, step: float, n: int) -> Column:
    """An array of n values from low in equal steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * F.lit(step))


def softmax(scores: Column) -> Column:
    """Softmax of an array of scores."""
    exps = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def argmax(scores: Column) -> Column:
    """Index from 0 of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def dot(values: Column, weights: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)


def calibration_bin(c: Column, bins: int = 10) -> Column:
    """The equal-width bin of a confidence; 1.0 falls into the last one."""
    return F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
