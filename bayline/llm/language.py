"""Language identification by error-correcting output codes.

Every learned language gets a codeword of bits. For each bit a logistic model over hashed byte
n-grams of the lower-cased text tells the languages with a 1 from those with a 0. Decoding is
loss-weighted: the language whose codeword has the least total logistic loss under the bits'
margins wins. A text is flagged as ambiguous when the runner-up's loss is within AMBIGUOUS.

The models are fitted on PER_LANGUAGE labelled rows of each language, chosen by a hash of the id;
with more than SAMPLE / PER_LANGUAGE languages on SAMPLE / languages of each, but on LEAST at least,
or all that a language has, so every language that a row has is learned. Prediction covers whole
texts, very long ones in pieces. Of languages with equal losses (ties) the first by name wins.

A null text, or one without a letter, is und with score 0. Without any labelled row every text is
und. Repeated rows get equal answers. Columns other than the id, the text and, for learning, the
language are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayline.llm.hashing import text_buffers
from bayline.llm.linear import fit, sample_each, sigmoid

SAMPLE, PER_LANGUAGE, LEAST = 2400, 600, 20
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
SIZES = (1, 2, 3)
AMBIGUOUS = 1.0
#: Bytes whose n-grams are hashed at once, and texts whose counts are weighed at once.
PIECE, ROWS = 1 << 20, 256
UNKNOWN = "und"


def codewords(n: int, seed: int = 9) -> np.ndarray:
    """An n x bits matrix of +1 and -1: all splits in two for few languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (split >> i) & 1 else -1 for split in range(1, 1 << (n - 1))] for i in range(n)])
    bits, rng = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, bits))
        gap = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if gap > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, gap
    return best


def ngram_buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte of data."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    key = np.full(n, size, np.uint32)
    for i in range(size):
        key = key << np.uint32(8) | data[i : i + n]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket's n-grams stand in one text, read in pieces."""
    total = np.zeros(BUCKETS)
    for size in SIZES:
        for at in range(0, len(data), PIECE):
            total += np.bincount(ngram_buckets(data[at : at + PIECE + size - 1], size), minlength=BUCKETS)
    return total


def frequencies(data: np.ndarray) -> np.ndarray:
    """Shares of the buckets among all n-grams of one text."""
    total = bucket_counts(data)
    return total / max(1.0, total.sum())


@dataclass
class LanguageModel:
    """Codewords and the bits' weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """The margin of each bit for each text of a column."""
        out = [np.empty((0, len(self.intercepts)))]
        for _, _, data, offsets in text_buffers(column, PIECE):
            buckets = [ngram_buckets(data, size) for size in SIZES] if len(offsets) > 2 else []
            counts = np.zeros((min(ROWS, len(offsets) - 1), BUCKETS))
            for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if buckets:  # n-grams that reach into the next text are not counted
                    total = counts[row % ROWS]
                    total[:] = 0
                    for size, found in zip(SIZES, buckets, strict=True):
                        if end - begin >= size:
                            total += np.bincount(found[begin : end - size + 1], minlength=BUCKETS)
                else:
                    counts[0] = bucket_counts(data)
                if row % ROWS == ROWS - 1 or row == len(offsets) - 2:
                    part = counts[: row % ROWS + 1]
                    out.append(part @ self.weights / np.maximum(part.sum(axis=1), 1)[:, None] + self.intercepts)
        return np.concatenate(out)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) by least logistic loss of the codeword's bits."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = share[np.arange(len(best)), best] / share.sum(axis=1)
        ordered = np.sort(loss, axis=1)
        close = ordered[:, 1] - ordered[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(best), bool)
        return best, score, close


def fit_languages(docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel | None:
    """Learn from the rows that allowed holds for and whose language is known."""
    rows = docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, F.lower(text).alias("text"), F.col(lang).alias("lang"))

    @F.arrow_udf("binary")
    def features(column: pa.Array) -> pa.Array:
        return pa.array([frequencies(np.frombuffer(x.as_py().encode(), np.uint8)).astype(np.float32).tobytes() for x in column], pa.binary())

    chosen = sample_each(rows, "lang", key, PER_LANGUAGE, SAMPLE, LEAST).select("lang", features("text").alias("x")).toArrow()
    if not chosen.num_rows:
        return None
    x = np.frombuffer(b"".join(chosen["x"].to_pylist()), np.float32).reshape(-1, BUCKETS)
    found = chosen["lang"].to_pylist()
    languages = sorted(set(found))
    code = codewords(len(languages))
    y = (code[[languages.index(z) for z in found]] > 0).astype(np.float32)
    weights, intercepts = fit(x, y, sigmoid, l2=1e-3, steps=150)
    return LanguageModel(languages, code, weights, intercepts)


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    kind = "struct<lang:string,score:double,ambiguous:boolean>"
    known = F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if model is None:
        answer = nothing
    else:
        names = pa.array(model.languages, pa.string())

        @F.arrow_udf(kind)
        def predict(column: pa.Array) -> pa.Array:
            best, score, close = model.decode(model.margins(column))
            parts = [names.take(pa.array(best, pa.int64())), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]
            return pa.StructArray.from_arrays(parts, ["lang", "score", "ambiguous"])

        answer = F.when(known, predict(F.lower(F.coalesce(text, F.lit(""))))).otherwise(nothing)
    return (
        docs.withColumn("__answer", answer)
        .withColumns({"lang_pred": F.col("__answer.lang"), "score": F.col("__answer.score"), "ambiguous": F.col("__answer.ambiguous")})
        .drop("__answer")
    )
