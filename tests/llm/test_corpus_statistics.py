"""Collocations, importance resampling and decontamination against plain versions, over odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from bayline.llm import catalogue, collocations, decontamination, importance
from bayline.llm.ranks import range_rank
from bayline.llm.words import normalised
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
QUERIES = {re.match(r"op(\d+)", name)[1]: query for name, query in catalogue.QUERIES.items()}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def bench_rows(odd_rows):
    long = next(t for _, t, *_ in odd_rows if t and len(plain_words(t)) > 100)
    return [
        (1, " ".join(plain_words(long)[10:40])), (2, " - ".join(plain_words(long)[20:35]).upper()), (3, "one two"), (4, None), (5, " ,. "), (None, long),
        (2, "card NUMBER: 4111"), (7, "never seen before " * 9), (8, "größe été 日本語"), (9, "x" * 70_000),
    ]


@pytest.fixture(scope="module")
def bench_dir(spark, odd_dir, tmp_path_factory, bench_rows):
    """The odd documents beside a benchmark that shares passages with them."""
    folder = tmp_path_factory.mktemp("bench")
    spark.read.parquet(f"{odd_dir}/documents.parquet").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, t, 1, "h") for i, t in bench_rows], "item_id long, text string, size int, hash string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}"


def plain_collocations(rows, least, longest, share, first):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {g: n for g, n in f.items() if n >= least}
    by_lang = collections.defaultdict(list)
    for (lang, *g), a in f.items():
        if len(g) == 1:
            continue
        longer = [n for (x, *h), n in f.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * n >= share * a for n in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, *g[:k]] + f[lang, *g[k:]]), k, f[lang, *g[:k]], f[lang, *g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return [
        (lang, i, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in by_lang.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1)
    ]


def phrase_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)] + ["É", "ß", "日"]
    rows = []
    for i in range(1500):
        words = rng.choices(vocabulary, [9 / (k + 3) for k in range(len(vocabulary))], k=rng.randint(0, 25))
        if i % 3 == 0:
            words[2:2] = ["New", "york", "city", "hall"]
        if i % 4 == 0:
            words += ["a", "a", "a", "a", "a"]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", "x\ty"])))
    return [*rows, (None, "en"), ("", "fr"), (" . ", "fr"), ("one two", "it")]


def test_collocations_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 9000)
    monkeypatch.setattr(collocations, "TURNS", 2)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "text string, lang string, id int, phrase string").repartition(3)
    found = collocations.collocations(docs).collect()
    expected = plain_collocations(rows, collocations.LEAST, collocations.LONGEST, collocations.SHARE, collocations.FIRST)
    assert len(expected) > 40 and sorted(tuple(r) for r in found) == sorted(expected)


def test_only_the_first_of_each_language_stay(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FANS", (8, 2, 1))
    rows = [(lang, f"p{i}", i % 7, i % 3) for lang in ("en", "de") for i in range(100)]
    found = collocations.first_of_each(spark.createDataFrame(rows, "lang string, phrase string, score long, a long"), 20)
    for lang in ("en", "de"):
        best = sorted(((-s, -a, p) for x, p, s, a in rows if x == lang))[:20]
        assert [(r.phrase, r.rank) for r in found.where(F.col("lang") == lang).orderBy("rank").collect()] == [(p, i) for i, (_, _, p) in enumerate(best, 1)]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_001
    rows = spark.createDataFrame([(big, big, big), (big, big, big + 5), (30, 30, 30), (7, 2**62, 2**62)], "a long, l long, r long")
    found = rows.select("a", "l", "r", collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 2_000_000 * r.a // (r.l + r.r) for r in found)


def test_a_shared_hash_does_not_join_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "pair_hash", lambda left, right: (left + right).astype(np.uint64))
    data = [collocations.pack([np.array(x) for x in ([1, 2, 5], [4, 3, 5], [20, 40, 1])], True), collocations.pack([np.array(x) for x in ([1, 3], [4, 2], [15, 40])], True)]
    table = pa.table([pa.array([0, 0]), pa.array([10, 11]), pa.array(data)], names=["part", "block", "data"])
    found = {r["block"]: r["data"] for r in collocations.add_groups(table).to_pylist()}
    groups = collocations.unpack(found[-1], 3)
    assert sorted(zip(*groups.tolist(), strict=True)) == [(1, 4, 35), (2, 3, 40), (3, 2, 40)]
    ranks = [collocations.unpack(found[b], 1)[0].tolist() for b in (10, 11)]
    assert [[groups[0][k] if k >= 0 else None for k in r] for r in ranks] == [[1, 2, None], [1, 3]]


def plain_resampling(docs, bench):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    own = [features(t) for _, t in docs]
    s, t = collections.Counter(x for f in own for x in f), collections.Counter(x for x in bench for x in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for (i, text), f in zip(docs, own, strict=True):
        gain = [math.floor(1000 * math.log((t[x] + 1) * (total_s + 10_000) / ((s[x] + 1) * (total_t + 10_000)))) for x in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(plain_words(text)), i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1], -r[3], r[2]))
    out = [(*r[1:], k if k <= 25 * len(able) // 100 else None) for k, r in enumerate(able, 1)]
    return out + [(*r[1:], None) for r in rows if r[0] < 20]


def test_resampling_against_brute_force(spark, bench_dir, odd_rows, bench_rows):
    expected = plain_resampling([r[:2] for r in odd_rows], [t for _, t in bench_rows])
    assert sum(r[4] is not None for r in expected) > 10
    assert collections.Counter(tuple(r) for r in QUERIES["12"](spark, bench_dir).collect()) == collections.Counter(expected)


def test_drawn_rows_keep_their_columns(spark, bench_dir):
    docs = spark.read.parquet(f"{bench_dir}/documents.parquet")
    bench = spark.read.parquet(f"{bench_dir}/benchmark.parquet")
    kept = importance.draw(docs, bench)
    ids = {r.doc_id for r in QUERIES["12"](spark, bench_dir).where("rank is not null").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids


def test_prefix_crcs_give_those_of_runs():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    assert importance.running_crcs(data).tolist() == [zlib.crc32(data[:i].tobytes()) for i in range(3001)]
    texts = ["Alpha beta,gamma  É日本 x", "", " - ", "y" * 9000 + " z", "b"]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words = normalised(flat, offsets)
    for n in (1, 2, 3):
        text, crcs = importance.run_crcs(words, importance.running_crcs(words.data), n)
        plain = [(i, zlib.crc32(" ".join(w[k : k + n]).encode())) for i, t in enumerate(texts) for w in [plain_words(t)] for k in range(len(w) - n + 1)]
        assert list(zip(text.tolist(), crcs.tolist(), strict=True)) == plain
    none = normalised(np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert importance.run_crcs(none, importance.running_crcs(none.data), 2)[1].tolist() == []


def test_range_ranks_are_places(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), rng.randrange(5)) for _ in range(500)]
    found = range_rank(spark.createDataFrame(rows, "a long, b long"), [F.desc("a"), F.asc("b")], "rank").orderBy("rank").collect()
    assert [(r.a, r.b, r["rank"]) for r in found] == [(a, b, i) for i, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)]
    assert range_rank(spark.createDataFrame([], "a long"), [F.asc("a")], "rank").count() == 0


def plain_hits(text, bench):
    w, hit, items = plain_words(text), set(), set()
    for item, body in bench:
        v = plain_words(body)
        k = min(len(v), 10)
        wanted = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wanted:
                hit.update(range(i, i + k))
                items.add("" if item is None else str(item))
    return w, hit, sorted(items)


@pytest.mark.parametrize("bound", [decontamination.BOUND, 3000])
def test_decontamination_against_brute_force(spark, bench_dir, odd_rows, bench_rows, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BOUND", bound)
    expected = []
    for i, text, *_ in odd_rows:
        w, hit, items = plain_hits(text, bench_rows)
        expected.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)))
    assert sum(r[5] for r in expected) > 5 and len({r[4] for r in expected}) > 3
    assert collections.Counter(tuple(r) for r in QUERIES["13"](spark, bench_dir).collect()) == collections.Counter(expected)


def test_hits_are_verified(spark, monkeypatch):
    """With one hash for all windows only equal words are hit."""
    monkeypatch.setattr(decontamination.SpanHashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    table = decontamination.WindowSet(decontamination.windows(bench).withColumn("hash", F.lit(0).cast("long")).toArrow())
    data = np.frombuffer(b"x a b c d e", np.uint8)
    words = normalised(data, np.array([0, len(data)]))
    assert len(table.bodies) == 2 and list(table.hits(words)) == [(1, 3, ["1"])]


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dog")], "item_id long, text string")
    rows = [(1, "He saw THE quick, brown FOX: and a Lazy-dog.", 5), (2, "the quick brown", 6), (3, None, 7), (4, "é the quick brown fox 日本 lazy dog", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contamination int")
    cut = {r.doc_id: r.text for r in decontamination.decontaminated(docs, bench).collect()}
    assert cut == {1: "He saw : and a .", 2: "the quick brown", 3: None, 4: "é  日本 "}
    kept = decontamination.decontaminated(docs, bench, remove="documents")
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows[1:3])
    with pytest.raises(ValueError, match="spans or documents"):
        decontamination.decontaminated(docs, bench, remove="words")


def test_empty_tables(spark, empty_dir, bench_dir):
    docs, bench = spark.read.parquet(f"{empty_dir}/documents.parquet"), spark.read.parquet(f"{bench_dir}/benchmark.parquet")
    full = spark.read.parquet(f"{bench_dir}/documents.parquet")
    assert importance.resampled(docs, bench).count() == 0 and decontamination.contamination(docs, bench).count() == 0
    assert importance.draw(docs, bench).count() == 0
    n = full.count()
    assert importance.resampled(full, bench.limit(0)).count() == n
    found = decontamination.contamination(full, bench.limit(0))
    assert found.where("contamination.n_hit > 0 or size(contamination.items) > 0").count() == 0 and found.count() == n
