"""Linear models fitted on the driver to bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels whose counts are broadcast.
FEW = 4096


def crc_of(column: str) -> Column:
    """The CRC-32 of a column written as text; of a null, that of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that the columns and the seed decide."""
    return (F.xxhash64(*columns, F.lit(seed)).bitwiseAND((1 << 52) - 1)).cast("double") / float(1 << 52)


def sample_each(rows: DataFrame, label: str, key: str, per_label: int, total: int, least: int) -> DataFrame:
    """The first per_label rows of each label by a hash of key; with many labels total / labels, but never fewer than least.

    A label with fewer rows keeps them all, so every label has a row. The answer has at most the
    greater of total and labels times least rows.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    labels = counts.count()
    each = max(least, min(per_label, total // max(1, labels)))
    if labels <= FEW:  # so few rows are sent to every task, and only likely rows are dealt by label
        counts = F.broadcast(counts)
    # twice and some more than is wanted, so that too few are left with a chance of less than 1e-9
    likely = rows.join(counts, label).where(unit_hash(key, seed=11) < (2 * each + 50) / F.col("__n"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(12)), key))
    return likely.withColumn("__place", place).where(F.col("__place") <= each).drop("__place", "__n")


def _largest_eigenvalue(x: np.ndarray, steps: int = 20) -> float:
    v = np.random.default_rng(5).standard_normal(x.shape[1]).astype(x.dtype)
    value = 1.0
    for _ in range(steps):
        v = x.T @ (x @ v)
        value = float(np.linalg.norm(v)) or 1.0
        v /= value
    return value / len(x)


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), safe for any z."""
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def softmax(z: np.ndarray) -> np.ndarray:
    """Each row's exponentials over their sum."""
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, link, l2: float = 1e-4, l1: float = 0.0, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and intercepts of a logistic or softmax model.

    Accelerated proximal gradient; features are centred and scaled meanwhile. l1 leads to sparse
    weights; the intercept is free of both penalties.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1
    z = ((x - mean) / scale).astype(np.float32)
    n, d = z.shape
    rate = 1 / (0.5 * (_largest_eigenvalue(z) + 1) + l2)
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    old_w, old_b, t = w, b, 1.0
    for _ in range(steps):
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / nxt
        vw, vb = w + k * (w - old_w), b + k * (b - old_b)
        residual = (link(z @ vw + vb) - y).astype(np.float32)
        old_w, old_b, t = w, b, nxt
        w = vw - rate * (z.T @ residual / n + l2 * vw)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b = vb - rate * residual.mean(axis=0)
    w = w / scale[:, None]
    return w.astype(np.float64), (b - mean @ w).astype(np.float64)
