"""The contract's columns of every query against brute force, over odd rows and empty tables."""

import collections
import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from bayline.llm import catalogue, media, topk

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
QUERIES = {re.match(r"op(\d+)", name)[1]: query for name, query in catalogue.QUERIES.items()}


def counted(rows):
    return collections.Counter(rows)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("n", sorted(QUERIES, key=int))
def test_empty_tables_give_no_rows(spark, empty_dir, n):
    assert QUERIES[n](spark, empty_dir).count() == 0


def plain_media(payload):
    """A payload's stored form and its features by their definitions, byte by byte."""
    h, last, form = 0, 0, [media.MAGIC]
    ends = []
    for i, byte in enumerate(payload):
        h = (h << 1) + int(media._GEAR[byte]) & 0xFFFFFFFF
        size = i + 1 - last
        if size == media.MAX_CHUNK or (size >= media.MIN_CHUNK and h >> (32 - media.MASK_BITS) == 0) or i + 1 == len(payload):
            ends.append(i + 1)
            last = i + 1
    for a, b in zip([0, *ends], ends, strict=False):
        packed = zstandard.compress(payload[a:b], media.LEVEL)
        form += [(b - a).to_bytes(4, "little"), len(packed).to_bytes(4, "little"), hashlib.sha256(payload[a:b]).digest(), packed]
    form = b"".join(form)
    n, counts = len(payload), collections.Counter(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(sum(c * (x - mean) ** 2 for x, c in counts.items()) / n)
    crossings = sum((a > mean) != (b > mean) for a, b in zip(payload, payload[1:], strict=False))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return len(form), hashlib.sha256(form).hexdigest(), (mean, deviation, max(payload), crossings, entropy)


def test_media(spark, odd_dir, odd_rows):
    found = collections.defaultdict(list)
    for r in QUERIES["1"](spark, odd_dir).collect():
        found[r.doc_id, r.payload_sha256].append(r)
    assert sum(map(len, found.values())) == len(odd_rows)
    for i, text, *_ in odd_rows:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        size, digest, features = plain_media(payload)
        r = found[i, hashlib.sha256(payload).hexdigest()].pop()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (size, digest)
        names = [x.split("=") for x in r.feature.split(",")]
        assert [k for k, _ in names] == ["mean", "deviation", "peak", "crossings", "entropy"]
        assert [float(v) for _, v in names] == pytest.approx(features, abs=1e-4)
    assert sum(len(list(media.chunks(t.encode()))) > 1 for _, t, *_ in odd_rows if t) > len(odd_rows) / 4


def test_shards(spark, odd_dir, odd_rows):
    found = QUERIES["2"](spark, odd_dir).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert counted((r.doc_id, r.size, r.text_crc32) for r in found) == counted((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    by_shard = collections.defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    place = collections.defaultdict(set)
    for r in found:
        place[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for key, s in place.items() if key[0] > 1)
    groups = collections.Counter()
    for _, text, *_ in odd_rows:
        groups[text] += size(text)
    heap = [0] * 8
    for n in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + n)
    loads = collections.Counter({i: 0 for i in range(8)})
    for r in found:
        loads[r.shard] += r.size
    assert sorted(loads.values()) == pytest.approx(sorted(heap), rel=2**-12)


def test_shards_of_the_tables_are_near_equal(spark):
    loads = collections.Counter()
    for r in QUERIES["2"](spark, "/root/testdata/sf0.01").collect():
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 0.001 * max(loads.values())


def test_mixing(spark, odd_dir, odd_rows):
    found = QUERIES["3"](spark, odd_dir).collect()
    assert counted((r.doc_id, r.n_tokens) for r in found) == counted((i, len(words(t))) for i, t, *_ in odd_rows)
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in found)


def test_mixing_meets_its_targets_on_the_tables(spark):
    from bayline.llm.mixing_query import TARGETS

    found = QUERIES["3"](spark, "/root/testdata/sf0.01").collect()
    total = sum(r.n_tokens for r in found)
    assert all(r.fit_met for r in found) and any(r.rate == 0 for r in found)
    for domain, share in TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{domain}"] for r in found) == pytest.approx(share * total, abs=1e-6 * total)


@pytest.mark.parametrize("bounds", [{}, {"SAMPLE": 20, "QUERIES": 2, "BLOCK": 64, "FIRST_DEPTH": 2}])
def test_topk(spark, odd_dir, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(topk, name, value)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect()]
    fine = [(i, [math.floor(1024 * x) for x in v] + [0] * (8 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, w in {i: w for i, w in sorted(fine, reverse=True) if i % 100 == 0}.items():
        scores = sorted((-int(np.dot(w, v)), i) for i, v in fine if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in QUERIES["4"](spark, odd_dir).collect()) == sorted(expected)


def test_quality_rows(spark, odd_dir, odd_rows):
    found = QUERIES["5"](spark, odd_dir).collect()
    assert counted((r.doc_id, r.held_out) for r in found) == counted((i, crc(i) % 3 == 1) for i, *_ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_tokens(spark, odd_dir, odd_rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, text, *_ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert counted(tuple(r) for r in QUERIES["6"](spark, odd_dir).collect()) == counted(expected)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, odd_dir, odd_rows):
    expected = []
    for i, text, *_ in odd_rows:
        t = text or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = collections.Counter(s[2] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        expected.append((i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined.encode()).hexdigest()))
    found = QUERIES["7"](spark, odd_dir).collect()
    assert counted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == counted(expected)
    assert sum(r.spans.count("card:") for r in found) == 1


def test_languages(spark, odd_dir, odd_rows):
    found = QUERIES["8"](spark, odd_dir).collect()
    assert counted((r.doc_id, r.held_out) for r in found) == counted((i, crc(i) % 4 == 2) for i, *_ in odd_rows)
    unknown = counted(i for i, t, *_ in odd_rows if not any(c.isalpha() for c in t or ""))
    assert counted(r.doc_id for r in found if r.lang_pred == "und") == unknown
    assert all(0 <= r.score <= 1 for r in found)


def test_scores(spark, odd_dir, odd_rows):
    tokens = [(i, [*words(t), None]) for i, t, *_ in odd_rows]
    c = collections.Counter(w for i, ws in tokens if crc(i) % 10 for w in ws)
    total, norm = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    expected = [(i, crc(i) % 10 == 0, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.1) / norm) for w in ws), 6)) for i, ws in tokens]
    found = QUERIES["9"](spark, odd_dir).collect()
    assert counted((*tuple(r)[:5], round(r.base_score, 6)) for r in found) == counted(expected)
    assert all(r.score <= 0 for r in found)


def brute_components(rows, n, num, den):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                    x, y = label[a], label[b]
                    label = [y if z == x else z for z in label]
    ids = collections.defaultdict(list)
    for z, row in zip(label, rows, strict=True):
        if row[0] is not None:
            ids[z].append(row[0])
    return [(row[0], len(s), (min(ids[z]) if ids[z] else None) if s else row[0]) for row, s, z in zip(rows, sets, label, strict=True)]


def test_components(spark, odd_dir, odd_rows):
    assert counted(tuple(r) for r in QUERIES["10"](spark, odd_dir).collect()) == counted(brute_components(odd_rows, 3, 90, 100))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = catalogue.QUERIES[name](spark, sf_dir)
    expected = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert counted(expected.fetchall()) == counted(tuple(r) for r in found.select(columns).collect())


def test_every_query_runs_at_the_smallest_scale(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for key, query in QUERIES.items():
        if key not in ("1", "2", "6", "9", "10", "11", "12", "13"):
            assert query(spark, sf_dir).count() == (50 if key == "4" else n)
