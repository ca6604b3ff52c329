"""A sparse ensemble of rules over text statistics, for quality.

Boosted shallow trees over the statistics of a bounded sample of labelled rows are cut into their
paths: each path from the root to a node is a rule, a conjunction of thresholds. A lasso logistic
model weighs the rules; those left with a weight are compiled into one Spark column expression, so
scoring is a projection over the native statistics columns.

The sample is at most SAMPLE labelled rows, chosen by a hash of the id. Statistics are taken over
whole texts. A null text counts as empty; empty texts get a score as well. Of labels that disagree
about an id the mean decides, a null label counts for nothing. Without labels of both kinds the
score is the mean label (1 without any) for every row. Repeated rows, and equal statistics (ties),
get equal scores; of the texts of a repeated labelled id the least is learned from. A very long
text is read as a whole by the task that holds its row. Other columns are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.llm.linear import fit, sigmoid

SAMPLE = 20_000
TREES, DEPTH, BINS, LEAF = 60, 3, 48, 15
SHRINKAGE, LASSO = 0.15, 4e-4


def statistics(text: str = "text") -> dict[str, Column]:
    """Native statistics of a text by name; per-character and per-word ones are shares."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars = F.greatest(F.char_length(t), F.lit(1))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(t, "\n")
    return {
        "log_chars": F.ln(F.char_length(t) + F.lit(1.0)),
        "log_words": F.ln(F.size(words) + F.lit(1.0)),
        "word_length": F.char_length(t) / n_words,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count(r"[0-9]") / chars,
        "symbols": count(r"[^\p{L}\p{N}\s.,]") / chars,
        "symbol_runs": count(r"([^\p{L}\p{N}\s])\1") / n_words,
        "stops": count(r"[.,]") / n_words,
        "spaced_symbols": count(r" [^\p{L}\p{N}\s](?= )") / n_words,
        "wide": F.octet_length(t) / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.ln(F.char_length(t) / F.size(lines) + F.lit(1.0)),
    }


Condition = tuple[int, bool, float]  # statistic, whether it is above, threshold


@dataclass
class RuleModel:
    """Weighted rules over named statistics."""

    names: list[str]
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """The score as a column expression over columns named as the statistics."""
        terms = [
            F.when(reduce(lambda a, b: a & b, [F.col(self.names[i]) > v if above else F.col(self.names[i]) <= v for i, above, v in rule]), F.lit(weight)).otherwise(F.lit(0.0))
            for rule, weight in self.rules
        ]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, residual: np.ndarray, weight: np.ndarray, path: tuple, depth: int, out: list) -> None:
    """Grow a regression tree on the residuals; out gets (path, rows, value) of every leaf."""
    best = (1e-9, None)
    if depth and len(rows) >= 2 * LEAF:
        g, h = residual[rows], weight[rows]
        base = g.sum() ** 2 / (h.sum() + 1e-6)
        for i, edge in enumerate(edges):
            if not len(edge):
                continue
            b = binned[rows, i]
            gs = np.cumsum(np.bincount(b, g, len(edge) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, h, len(edge) + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=len(edge) + 1))[:-1]
            gain = gs**2 / (hs + 1e-6) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1e-6) - base
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (i, k))
    if best[1] is None:
        out.append((path, rows, residual[rows].sum() / (weight[rows].sum() + 1e-6)))
        return
    i, k = best[1]
    above = binned[rows, i] > k
    for side in (False, True):
        _grow(x, edges, binned, rows[above == side], residual, weight, (*path, (i, side, float(edges[i][k]))), depth - 1, out)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """The paths of boosted trees, to inner nodes as well, each once."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = sigmoid(score)
        leaves: list = []
        _grow(x, edges, binned, np.arange(len(y)), y - p, p * (1 - p), (), DEPTH, leaves)
        for path, rows, value in leaves:
            score[rows] += SHRINKAGE * np.clip(value, -4, 4)
            for n in range(1, len(path) + 1):
                rules[path[:n]] = None
    return list(rules)


def fires(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    """Where all conditions of a rule hold."""
    out = np.ones(len(x), bool)
    for i, above, value in rule:
        out &= x[:, i] > value if above else x[:, i] <= value
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Rules and their lasso weights from statistics x and labels y in {0, 1}."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 1.0
        return RuleModel(names, [], 40.0 if mean >= 0.5 else -40.0)
    paths = tree_rules(x, y)
    if not paths:
        return RuleModel(names, [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    matrix = np.stack([fires(x, p) for p in paths], axis=1).astype(np.float32)
    weights, intercept = fit(matrix, y[:, None].astype(np.float32), sigmoid, l2=0.0, l1=LASSO, steps=400)
    kept = [(p, float(w)) for p, w in zip(paths, weights[:, 0], strict=True) if abs(w) > 1e-6]
    return RuleModel(names, kept, float(intercept[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most sample labelled ids, the least text of each; allowed is a condition on doc_id."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.avg(label).alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id")
        .limit(sample)
    )
    # one text an id, so no more than sample rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def learn_quality(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality") -> RuleModel:
    """Fit the ensemble to a label of the rows that allowed holds for."""
    stats = statistics()
    rows = labelled_sample(docs, labels, label, allowed).orderBy(F.xxhash64("doc_id"), "doc_id").select("y", *(c.alias(n) for n, c in stats.items())).toPandas()
    x = rows[list(stats)].to_numpy(float)
    return fit_rules(x, (rows["y"].to_numpy(float) >= 0.5).astype(float), list(stats))


def score_quality(docs: DataFrame, model: RuleModel, out: str = "score") -> DataFrame:
    """docs with the score as column out; the statistics' columns go again."""
    stats = {f"__{n}": c for n, c in statistics().items()}
    named = RuleModel([f"__{n}" for n in model.names], model.rules, model.intercept)
    return docs.withColumns(stats).withColumn(out, named.score()).drop(*stats)
