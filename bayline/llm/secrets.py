"""Secret scans: keyword automaton, anchored patterns near its hits, checksum validation.

Spans of a text, as code points with exclusive ends:

* assign - a credential keyword, an equals sign or colon, and a value of 6 or more characters
* access - AKIA and capitals or digits, 20 or more characters
* hex - a run of 24 or more lower-case hexadecimal digits
* forge - a code-forge token whose last six characters are the base-62 CRC-32 of its body
* registry - a package-registry token with the same checksum
* card - a payment number of 13 to 19 digits after a card keyword that passes the Luhn test

The first three are the base kinds: no checksum takes one away. The others count only if the
checksum inside the span holds.

Null and empty texts have no spans. Repeated rows are scanned alike, each by itself; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayline.llm.hashing import text_buffers

KINDS = ("assign", "access", "hex", "forge", "registry", "card")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_FORGE = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_REGISTRY = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_CARD = re.compile(rb"card(?:[\x20_-]?(?:number|no))?[\"']?\x20*[:=#]\x20*[\"']?((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])", re.IGNORECASE)
#: Keywords as they stand in the lower-cased text, and the kind whose pattern begins there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign",
    "apikey": "assign", "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge",
    "ghr_": "forge", "npm_": "registry", "card": "card",
}
HEX_LENGTH = 24
_DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def base62_crc(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of body."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS62[digit : digit + 1] + out
    return out


def luhn(digits: bytes) -> bool:
    """Whether a payment number's check digit holds."""
    found = [d - 48 for d in digits if 48 <= d <= 57]
    doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(found))]
    return 13 <= len(found) <= 19 and sum(doubled) % 10 == 0 and len(set(found)) > 1


def keyword_automaton() -> ahocorasick.Automaton:
    """The prefilter: finds every keyword in one pass over a lower-cased text."""
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def _valid(kind: str, match: re.Match) -> tuple[int, int] | None:
    """The span of a match that passes its kind's length rule or checksum."""
    if kind == "assign":
        return match.span() if len(match[2]) >= 6 else None
    if kind == "access":
        return match.span() if len(match[0]) >= 20 else None
    if kind == "card":
        return match.span(1) if luhn(match[1]) else None
    return match.span() if base62_crc(match[0][4:-6]) == match[0][-6:] else None


_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "forge": _FORGE, "registry": _REGISTRY, "card": _CARD}


def hex_spans(data: np.ndarray, text: bytes, offset: int, end: int) -> list[tuple[int, int]]:
    """Runs of hexadecimal digits of at least HEX_LENGTH bytes in text = data[offset:end].

    A run of that length covers a byte at a multiple of half of it and the next such byte too;
    only where both are digits is the run looked at.
    """
    step = HEX_LENGTH // 2
    probes = _IS_HEX[data[offset:end:step]]
    spans, last = [], 0
    for i in np.flatnonzero(probes[:-1] & probes[1:]) if len(probes) > 1 else ():
        at = int(i) * step
        if at < last:
            continue
        start = at
        while start > last and _IS_HEX[text[start - 1]]:
            start -= 1
        last = _HEX.match(text, start).end()
        if last - start >= HEX_LENGTH:
            spans.append((start, last))
    return spans


def scan_bytes(data: np.ndarray, offset: int, end: int, hits: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """All spans of one text in bytes; hits are the automaton's (start, kind) in that text."""
    hexes = None
    text = data[offset:end].tobytes()
    spans, ends = [], dict.fromkeys(_PATTERNS, 0)
    for start, kind in hits:
        if start >= ends[kind] and (match := _PATTERNS[kind].match(text, start)):
            ends[kind] = match.end()
            if span := _valid(kind, match):
                spans.append((*span, kind))
    hexes = hex_spans(data, text, offset, end)
    spans += [(a, b, "hex") for a, b in hexes]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_column(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    """Spans of every text of a column, in code points."""
    automaton, out = keyword_automaton(), []
    for first, last, data, offsets in text_buffers(column):
        lowered = data.tobytes().lower().decode("latin-1")
        found: dict[int, list[tuple[int, str]]] = {}
        if hits := [(end - n + 1, n, kind) for end, (n, kind) in automaton.iter(lowered)]:
            starts = np.array([h[0] for h in hits])
            rows = np.searchsorted(offsets, starts, side="right") - 1
            for (start, n, kind), row in zip(hits, rows.tolist(), strict=True):
                if start + n <= offsets[row + 1]:
                    found.setdefault(row, []).append((start - int(offsets[row]), kind))
        for hits_of_row in found.values():
            hits_of_row.sort()
        # both probes of a long run are digits: rows without two such neighbours have no hex span
        for row in range(last - first):
            a, b = int(offsets[row]), int(offsets[row + 1])
            spans = scan_bytes(data, a, b, found.get(row, []))
            if spans:
                marks = np.cumsum((data[a:b] & 0xC0) != 0x80)
                points = lambda at: int(marks[at - 1]) if at else 0  # noqa: B023, E731
                spans = [(points(x), points(y), kind) for x, y, kind in spans]
            out.append(spans)
    return out


SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with a column out of secret spans in order of start, then of KINDS."""

    @F.arrow_udf(SPAN_TYPE)
    def spans(column: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": a, "end": b} for a, b, k in row] for row in scan_column(column)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, kind)

    return docs.withColumn(out, spans(F.col(text)))


def redact(text: str | None, spans: list) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    if text is None or not len(spans):
        return text
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{span['kind']}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets of text replaced, and n_chars following; other columns as they are."""

    @F.arrow_udf("string")
    def cut(column: pa.Array) -> pa.Array:
        rows = zip(column.to_pylist(), scan_column(column), strict=True)
        return pa.array([redact(t, [{"kind": k, "start": a, "end": b} for a, b, k in found]) for t, found in rows], pa.string())

    out = docs.withColumn("text", cut(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out

