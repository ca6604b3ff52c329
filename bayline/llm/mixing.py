"""Soft-membership mixing of domains to target token weights.

A softmax classifier, fitted on a labelled table, gives each document a posterior over domains. A
document's rate says how often it is to be read; the expected tokens of a domain are the sum over
documents of rate, tokens and posterior. Projected-gradient least squares moves all rates, from 1,
until these sums match the targets: each step goes down the gradient of the squared error and
projects every rate to zero or above (and, where max_rate is given, to that or below). The error is
measured in the metric of the inverse Gram matrix of the posteriors of the documents whose rates
are still free to move, so steps of length one settle fast even when many rates stand at a bound.
Each step is one aggregate over the documents, of which the driver sees k + k * k numbers for k
domains; since a step moves a document's rate by a function of its own posterior only, the steps
so far give the rate as a column expression.

The fit ends when the sums are within CLOSE of all tokens of the targets. Targets that no rates in
the bounds can meet are not met: the fit then ends after STEPS steps with the best rates it saw,
Rates.converged is false and a warning is given.

The classifier is fitted on at most SAMPLE labelled rows, PER_DOMAIN of each domain, chosen by a
hash of the id (with very many domains on one of each). Posteriors, tokens and sums cover all documents and whole texts.

A null or empty text has no tokens and the posterior of the intercepts; it changes no sum. A
document labelled more than once takes the least of its domains, null labels count for nothing.
Without labelled rows there is one domain, None, with posterior 1. Repeated rows get equal rates,
as do equal posteriors (ties). Very long texts count with all their tokens. Of the texts of a
repeated id the classifier is fitted on the least.
Columns of docs named as the result's are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.llm.hashing import text_buffers, word_hashes
from bayline.llm.linear import fit, sample_each, softmax, unit_hash
from bayline.llm.store import materialise

SAMPLE, PER_DOMAIN = 6000, 2000
#: Words whose presence the classifier looks at.
WORDS = 1024
STEPS, CLOSE = 25, 1e-7


def _byte_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 256 byte shares for each text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256)
    return counts / np.maximum(np.diff(offsets), 1)[:, None]


@dataclass
class DomainModel:
    """A softmax over the presence of chosen words and the shares of bytes."""

    domains: list[str | None]
    words: np.ndarray  # hashes, ascending
    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each text."""
        sizes, rows = [np.empty(0, np.int64)], [np.empty((0, len(self.domains)))]
        k = len(self.words)
        for _, _, data, offsets in text_buffers(column, 1 << 20):
            hashes, bounds = word_hashes(data, offsets)
            n = len(offsets) - 1
            score = np.tile(self.intercepts, (n, 1)) + _byte_shares(data, offsets) @ self.weights[k:]
            if k:
                at = np.minimum(np.searchsorted(self.words, hashes), k - 1)
                hit = self.words[at] == hashes
                text = np.repeat(np.arange(n), np.diff(bounds))
                seen = np.unique(text[hit] * k + at[hit])
                for d in range(len(self.domains)):
                    score[:, d] += np.bincount(seen // k, self.weights[seen % k, d], n)
            sizes.append(np.diff(bounds))
            rows.append(softmax(score))
        return np.concatenate(sizes), np.concatenate(rows)


def fit_domains(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain") -> DomainModel:
    """Learn the domains of labelled (key, domain), one row or more for each labelled document."""
    known = labelled.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).groupBy(key).agg(F.min(domain).alias("domain"))
    chosen = sample_each(known, "domain", key, PER_DOMAIN, SAMPLE, 1)

    @F.arrow_udf("struct<words:binary,bytes:binary>")
    def features(column: pa.Array) -> pa.Array:
        words, shares = [], []
        for _, _, data, offsets in text_buffers(column):
            hashes, bounds = word_hashes(data, offsets)
            words += [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            shares += [r.astype(np.float32).tobytes() for r in _byte_shares(data, offsets)]
        return pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(shares, pa.binary())], ["words", "bytes"])

    # one text an id, so no more than SAMPLE rows
    sampled = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).groupBy(key, "domain").agg(F.min("text").alias("text"))
    rows = sampled.orderBy(F.xxhash64(key), key).select("domain", features("text").alias("x")).toArrow()
    found = rows["domain"].to_pylist()
    domains = sorted(set(found))
    if len(domains) < 2:
        return DomainModel(domains or [None], np.empty(0, np.uint64), np.zeros((256, max(1, len(domains)))), np.zeros(max(1, len(domains))))
    y = np.array([domains.index(d) for d in found])
    x = rows["x"].combine_chunks()
    sets = [np.frombuffer(w.as_py(), np.uint64) for w in x.field("words")]
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocabulary, at = np.unique(flat, return_inverse=True)
    per_domain = np.stack([np.bincount(at[y[doc] == d], minlength=len(vocabulary)) for d in range(len(domains))], axis=1)
    size = np.bincount(y, minlength=len(domains))
    expected = per_domain.sum(axis=1, keepdims=True) * size / size.sum()
    surprise = ((per_domain - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=1)
    pick = np.sort(np.argsort(-surprise, kind="stable")[:WORDS])
    place = np.full(len(vocabulary), -1)
    place[pick] = np.arange(len(pick))
    matrix = np.zeros((len(sets), len(pick) + 256), np.float32)
    inside = place[at] >= 0
    matrix[doc[inside], place[at[inside]]] = 1
    matrix[:, len(pick) :] = np.frombuffer(b"".join(b.as_py() for b in x.field("bytes")), np.float32).reshape(-1, 256)
    weights, intercepts = fit(matrix, np.eye(len(domains), dtype=np.float32)[y], softmax, l2=3e-3, steps=150)
    return DomainModel(domains, vocabulary[pick], weights, intercepts)


def with_posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """docs with n_tokens and posterior, an array in the order of the model's domains."""

    @F.arrow_udf("struct<n:long,p:array<double>>")
    def predict(column: pa.Array) -> pa.Array:
        n, p = model.predict(column)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(model.domains), pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], ["n", "p"])

    return docs.withColumn("__x", predict(F.col(text))).withColumns({"n_tokens": F.col("__x.n"), "posterior": F.col("__x.p")}).drop("__x")


@dataclass
class Rates:
    """The steps of the fit and what they reached."""

    steps: list[list[float]] = field(default_factory=list)
    max_rate: float | None = None
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    total: float = 0.0

    @property
    def error(self) -> float:
        """The largest miss of a target, as a share of all tokens."""
        return max((abs(a - b) for a, b in zip(self.reached, self.targets, strict=True)), default=0.0) / max(self.total, 1.0)

    @property
    def converged(self) -> bool:
        """Whether the targets are met."""
        return self.error <= CLOSE

    def column(self, posterior: str = "posterior") -> Column:
        """The rate as an expression over the posterior."""
        rate: Column = F.lit(1.0)
        for step in self.steps:
            rate = rate - reduce(lambda a, b: a + b, [F.col(posterior)[i] * g for i, g in enumerate(step)])
            rate = F.greatest(rate, F.lit(0.0))
            if self.max_rate is not None:
                rate = F.least(rate, F.lit(float(self.max_rate)))
        return rate


def domain_tokens(scored: DataFrame, model: DomainModel, weight: Column | None = None) -> list[float]:
    """The expected tokens of each domain, documents weighted by weight."""
    share = F.col("n_tokens").cast("double") * (F.lit(1.0) if weight is None else weight)
    return list(scored.select((share).alias("w"), "posterior").agg(*(_total(F.col("w") * F.col("posterior")[i]) for i in range(len(model.domains)))).first())


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def fit_rates(scored: DataFrame, model: DomainModel, wanted: list[float], max_rate: float | None = None) -> Rates:
    """Fit rates so that each domain's expected tokens are those wanted.

    scored is a written table with n_tokens and posterior.
    """
    k = len(model.domains)
    p = [F.col("posterior")[i] for i in range(k)]
    n = F.col("n_tokens").cast("double")
    out = Rates(max_rate=max_rate, targets=[float(x) for x in wanted], total=float(scored.agg(_total(n)).first()[0]))
    best, tried = np.inf, []
    for _ in range(STEPS + 1):
        inside = (F.col("r") > 0) & (F.lit(True) if max_rate is None else F.col("r") < max_rate)
        free = F.when(inside, n).otherwise(0.0) if tried else n
        sums = scored.withColumn("r", Rates(tried, max_rate).column()).withColumn("f", free)
        found = sums.agg(*(_total(F.col("r") * n * x) for x in p), *(_total(F.col("f") * x * y) for x in p for y in p)).first()
        reached, gram = np.array(found[:k], float), np.array(found[k:], float).reshape(k, k)
        miss = np.abs(reached - out.targets).max(initial=0.0)
        if miss < best:
            best, out.steps, out.reached = miss, list(tried), reached.tolist()
        if out.converged:
            break
        gram += np.eye(k) * max(1e-9 * np.trace(gram), 1e-9)
        tried = [*tried, np.linalg.solve(gram, reached - out.targets).tolist()]
    if not out.converged:
        warnings.warn(f"the mixture misses its targets by {out.error:.1e} of all tokens", stacklevel=2)
    return out


Targets = Mapping[str, float | None] | Callable[[DataFrame, DomainModel], list[float]]


def mix(docs: DataFrame, labelled: DataFrame, targets: Targets, max_rate: float | None = None, key: str = "doc_id") -> tuple[DataFrame, DomainModel, Rates]:
    """docs with n_tokens, posterior, rate and copies; the model; the fit.

    targets are shares of all tokens by domain (a domain without one, or with None, keeps its
    tokens) or a function of the scored documents and the model that gives each domain's tokens.
    copies is the rate rounded up or down by a hash of the id, so that its mean is the rate.
    """
    model = fit_domains(docs, labelled, key)
    docs = docs.drop("n_tokens", "posterior", "rate", "copies")
    scored = materialise(with_posteriors(docs.select("text"), model).select("n_tokens", "posterior"))
    if callable(targets):
        wanted = targets(scored, model)
    else:
        natural = domain_tokens(scored, model)
        wanted = [x if targets.get(d) is None else targets[d] * sum(natural) for d, x in zip(model.domains, natural, strict=True)]
    rates = fit_rates(scored, model, wanted, max_rate)
    scored = with_posteriors(docs, model).withColumn("rate", rates.column())
    return scored.withColumn("copies", F.floor(F.col("rate") + unit_hash(key, seed=17)).cast("int")), model, rates


def thinned(domain: str, share: float) -> Callable[[DataFrame, DomainModel], list[float]]:
    """Targets: the tokens of a corpus in which documents that are likelier of domain than not are read share times, others once.

    Rates between share and 1 that meet them exist, so they can be met under a max_rate of 1.
    """

    def tokens(scored: DataFrame, model: DomainModel) -> list[float]:
        if domain not in model.domains:
            return domain_tokens(scored, model)
        likely = F.col("posterior")[model.domains.index(domain)] > 0.5
        return domain_tokens(scored, model, F.when(likely, float(share)).otherwise(1.0))

    return tokens


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else poor or good by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
