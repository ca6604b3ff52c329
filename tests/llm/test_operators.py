"""The corpus operators' parts on their own."""

import collections
import itertools
import math
import random
import re
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from bayline.llm import bpe, hashing, jaccard, language, media, mixing, rules, secrets, shards, topk, transducer
from bayline.llm.components import connected_components
from bayline.llm.frequent import most_frequent
from bayline.llm.linear import sigmoid


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    texts = ["Alpha beta\tGAMMA", "", "  ", "beta", "gamma alpha " * 50, "delta" * 40]
    flat = pa.array(texts)
    (_, _, data, offsets), = hashing.text_buffers(flat)
    whole, bounds = hashing.word_hashes(data, offsets)
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    pieces, cuts = hashing.word_hashes(data, offsets)
    assert (whole == pieces).all() and (bounds == cuts).all()
    by_word = {}
    for i, t in enumerate(texts):
        for w, h in zip(t.lower().split(), whole[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)]
    label = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted(n for n in label if any(n in e and e[0] != e[1] for e in edges))
    assert sorted(found) == nodes
    for a, b in itertools.pairwise(nodes):
        assert (found[a] == found[b]) == (label[a] == label[b])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("n", "num", "den", "hot"), [(3, 90, 100, 3), (5, 80, 100, 0), (1, 50, 100, 3), (3, 90, 100, 1000)])
def test_similarity_join_against_all_pairs(spark, n, num, den, hot, monkeypatch):
    from tests.llm.test_queries import brute_components

    monkeypatch.setattr(jaccard, "BUCKET", 4)
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 2000)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(n)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 80))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 14)):
            w = list(b)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Similarity(n, num, den))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_components(rows, n, num, den))


def test_shared_passages_do_not_join_candidates(spark, monkeypatch):
    """Many passages, each in many documents: the order keeps them out of prefixes, however many they are."""
    monkeypatch.setattr(jaccard, "HOT", 0)
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    rng = random.Random(5)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(40)]
    rows = []
    for i in range(240):
        own = " ".join(f"d{i}x{j}" for j in range(12))
        rows.append((i, " ".join([own, *rng.sample(passages, 2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = jaccard.Similarity(3, 90, 100)
    nodes = jaccard.materialise(jaccard.document_sets(docs, rule).selectExpr("node", "size", "low"))
    groups = jaccard.prefix_groups(docs, nodes, rule)
    assert groups.where("prefix is null").count() == 0 and groups.count() == 240
    assert jaccard.candidate_edges(groups, rule).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 100_000, dtype=np.uint8).tobytes()
    a = dict(media.chunks(body))
    b = dict(media.chunks(b"some words more" + body))
    assert b"".join(c for _, c in media.chunks(body)) == body
    assert sum(len(c) for d, c in a.items() if d in b) > 0.7 * len(body)
    sizes = [len(c) for _, c in media.chunks(body)]
    assert max(sizes) <= media.MAX_CHUNK and min(sizes[:-1]) >= media.MIN_CHUNK


def test_rolling_hash_equals_its_definition():
    data = np.random.default_rng(1).integers(0, 256, 200, dtype=np.uint8)
    h = media.gear_hashes(data)
    for i in (0, 5, 31, 32, 150):
        expected = sum(int(media._GEAR[data[i - k]]) << k for k in range(min(i + 1, media.WINDOW))) % (1 << 32)
        assert int(h[i]) == expected


def test_damaged_chunks_are_found_out(spark):
    payloads = spark.createDataFrame([(bytearray(b"a" * 64),), (bytearray(range(256)) * 40,)], "payload binary")
    split = media.split_payloads(payloads)
    lists, stores = media.chunk_lists(split), [media.chunk_store(split, t) for t in range(media.TURNS)]
    pieces = [media.list_pieces(lists, s, t) for t, s in enumerate(stores)]
    assert sum(media.read_media(pieces, i).count() for i in range(media.TURNS)) == 2
    damaged = [p.withColumn("stored", F.lit(zstandard.compress(b"another"))).withColumn("length", F.lit(7)) for p in pieces]
    with pytest.raises(Exception, match="does not match its digest"):
        for i in range(media.TURNS):
            media.read_media(damaged, i).collect()


def test_the_store_can_be_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc " * 900), (2, "abc " * 900), (3, None)], "doc_id long, text string")
    assert media.media_columns(docs, keep=f"file://{tmp_path}/store").count() == 3
    chunks = {bytes(r.digest): zstandard.decompress(r.stored) for r in spark.read.parquet(f"file://{tmp_path}/store/chunks").collect()}
    lists = collections.defaultdict(list)
    for r in spark.read.parquet(f"file://{tmp_path}/store/lists").orderBy("seq").collect():
        lists[bytes(r.payload)].append(chunks[bytes(r.digest)])
    assert sorted(b"".join(x) for x in lists.values()) == [b"\0" * 64, b"abc " * 900 + b"\0" * 48]


def test_texts_of_the_corpus_share_the_chunks_of_a_passage(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    passage = prose(900)  # some 5,900 bytes
    texts = [prose(60) + " " + passage + " " + prose(90), prose(25) + " " + passage, prose(400)]
    a, b, c = (dict(media.chunks(t.encode())) for t in texts)
    shared = sum(len(a[d]) for d in set(a) & set(b))
    assert shared > 0.5 * len(passage) and not set(a) & set(c)
    payloads = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "payload binary")
    row = media.chunk_sharing(media.chunk_lists(media.split_payloads(payloads))).first()
    assert (row.payloads, row.of_several) == (3, 3) and row.shared == len(set(a) & set(b)) and row.entries == len(a) + len(b) + len(c)


def test_join_with_hot_keys_keeps_every_row(spark):
    from bayline.llm.hot import hot_keys, join_one

    many = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then -1 else id % 1000 end as k").union(spark.createDataFrame([(-5, None)], "id long, k long"))
    one = spark.range(-1, 990).selectExpr("id as k", "id * 2 as v")
    found = join_one(many, one, "k")
    assert len(hot_keys(many, "k")) == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, many.join(one, "k").collect()))
    assert join_one(many.limit(0), one, "k").count() == 0


def test_class_deal_equals_the_heap():
    import heapq

    rng = random.Random(1)
    for _ in range(200):
        loads = [rng.choice([0.0, rng.random() * 1e4]) for _ in range(rng.randint(1, 9))]
        size, n = rng.randint(1, 500), rng.randint(0, 400)
        heap = [(x, i) for i, x in enumerate(loads)]
        for _ in range(n):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + size, i)) if heap == sorted(heap) else (heapq.heapify(heap), heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1])))
        given = shards.deal_class(loads, size, n)
        assert sum(given) == n and np.allclose(sorted(loads), sorted(x for x, _ in heap))


def test_threshold_search_stops_early_and_exactly():
    rng = np.random.default_rng(2)
    data = np.zeros((5000, 6), np.int64)
    data[:, 0] = rng.integers(0, 10**6, 5000)
    data[:, 1:] = rng.integers(0, 50, (5000, 5))
    order = np.argsort(-data, axis=0, kind="stable")
    weights = np.array([3, 1, 0, -1, 2, 1])
    best, scores, depth = topk.threshold_search(np.arange(5000), data, order, 7, weights, 10)
    every = data @ weights
    every[7] = -(10**9)
    assert scores.tolist() == np.sort(every)[::-1][:10].tolist() and depth < 200


def test_transducer_shares_suffixes_and_maps(tmp_path):
    words = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"ed", b"ing", b"ings"))
    entries = [(w, (i, i * 2) if i % 2 else (9, i)) for i, w in enumerate(words)]
    path = tmp_path / "lexicon.bin"
    path.write_bytes(transducer.build(entries))
    lexicon = transducer.Transducer.map(str(path))
    found, ids, sizes = lexicon.lookup([*words, b"walks", b"", b"talkings"])
    assert found.tolist() == [True] * 12 + [False, False, True][:2] + [True] and sizes.sum() == len(ids)
    assert ids[:24].tolist() == [x for _, out in entries for x in out]
    plain = transducer.Transducer(transducer.build([(w, (1,)) for w in words]))
    assert len(plain.rests) < 20


def test_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(6)
    letters = "ab cde\n\t  '!.,éñ日🙂\x1c\x85\xa0 tsrvml0123²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["aaaaaaa" * 9, "=" * 500, "<|endoftext|>a<|endoftext|>"]
    ids, ends = bpe.Encoder(path).encode(texts)
    for text, a, b, expected in zip(texts, ends, ends[1:], library.encode_batch(texts, add_special_tokens=False), strict=False):
        assert ids[a:b].tolist() == expected.ids, repr(text)


def test_long_words_are_merged_in_near_linear_time():
    import time

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (63, 64, 65, 66, 1000, 160_000)] + ["é" * 40, "ab" * 5000, "x" * 70]
    bpe.vocabulary(path)
    began = time.perf_counter()
    ids, ends = bpe.Encoder(path).encode(texts)
    assert time.perf_counter() - began < 10
    for text, a, b, expected in zip(texts, ends, ends[1:], library.encode_batch(texts, add_special_tokens=False), strict=False):
        assert ids[a:b].tolist() == expected.ids, len(text)


def test_checksums():
    body = "A" * 30
    token = "ghp_" + body + secrets.base62_crc(body.encode()).decode()
    good, bad = secrets.scan_column(pa.array([f"é {token} end", f"é {token[:-1]}{'x' if token[-1] != 'x' else 'y'} end"]))
    assert [s for s in good if s[2] == "forge"] == [(2, 2 + len(token), "forge")] and not bad
    assert secrets.luhn(b"4111111111111111") and not secrets.luhn(b"4111111111111112")
    spans = [{"kind": "assign", "start": 2, "end": 9}, {"kind": "hex", "start": 4, "end": 8}]
    assert secrets.redact("a bcdefgh i", spans) == "a [assign] i" and secrets.redact(None, []) is None


def test_checked_spans_against_a_search_of_whole_texts():
    """forge, registry and card spans, found without keywords: every match of the pattern, then its checksum."""
    alphabet = string.digits + string.ascii_uppercase + string.ascii_lowercase

    def check(body: str) -> str:
        value = zlib.crc32(body.encode())
        return "".join(alphabet[value // 62**k % 62] for k in range(5, -1, -1))

    def card_holds(digits: str) -> bool:
        found = [int(d) for d in digits if d.isdigit()]
        total = sum(found[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in found[-2::-2])
        return 13 <= len(found) <= 19 and total % 10 == 0 and len(set(found)) > 1

    def brute(text: str) -> list[tuple[int, int, str]]:
        spans = []
        for kind, pattern in (("forge", "gh[pousr]_"), ("registry", "npm_")):
            for m in re.finditer(pattern + "([A-Za-z0-9]{36})(?![A-Za-z0-9])", text):
                if check(m[1][:30]) == m[1][30:]:
                    spans.append((*m.span(), kind))
        for m in re.finditer(r"card(?:[ _-]?(?:number|no))?[\"']? *[:=#] *[\"']?((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", text, re.I | re.A):
            if card_holds(m[1]):
                spans.append((*m.span(1), "card"))
        return sorted(spans)

    rng = random.Random(11)
    texts, planted = [], 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(6)):
            body = "".join(rng.choices(alphabet, k=30))
            tail = check(body) if rng.random() < 0.6 else "".join(rng.choices(alphabet, k=6))
            token = rng.choice(["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", "ghx_", "GHP_"]) + body + tail
            digits = "".join(rng.choices(string.digits, k=rng.choice([12, 15, 15, 15, 19])))
            digits += next(d for d in string.digits if card_holds(digits + d) or d == "9")
            card = rng.choice(["card: ", "Card number=", 'card_no": "', "cardno# ", "cart: "]) + rng.choice([digits, " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))])
            parts += [rng.choice([token, card, token + "x", "x" + token, "ñ日" + token]), rng.choice([" ", "", "\n", "é"])]
        texts.append("".join(parts))
        planted += len(brute(texts[-1]))
    found = secrets.scan_column(pa.array([*texts, None, ""]))
    base = set(secrets.BASE_KINDS)
    assert [[s for s in row if s[2] not in base] for row in found] == [*map(brute, texts), [], []]
    assert planted > 200


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = language.codewords(n)
        distance = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(distance) >= 1 and (n < 3 or min(distance) >= 2)


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    model = rules.fit_rules(x, y, ["a", "b", "c", "d"])
    score = sum(w * rules.fires(x, r) for r, w in model.rules) + model.intercept
    assert ((sigmoid(score) >= 0.5) == y.astype(bool)).mean() > 0.98
    assert rules.fit_rules(x[:0], y[:0], ["a"] * 4).rules == []


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    from bayline.llm.rules_query import op5_quality_rules

    scored = op5_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def plain_statistics(text: str | None) -> dict[str, float]:
    """The statistics of rules.py by their meaning, one text at a time."""
    t = text or ""
    words, lines = [w for w in t.split(" ") if w], t.split("\n")
    chars, n = max(len(t), 1), max(len(words), 1)
    space = " \t\n\x0b\f\r"
    letter = [unicodedata.category(c)[0] in "LN" for c in t]
    odd = [not a and c not in space for a, c in zip(letter, t, strict=True)]
    runs, i = 0, 0
    while i + 1 < len(t):
        found = odd[i] and t[i] == t[i + 1]
        runs, i = runs + found, i + 1 + found
    spaced = sum(t[i] == " " and odd[i + 1] and t[i + 2] == " " for i in range(len(t) - 2))
    return {
        "log_chars": math.log(len(t) + 1), "log_words": math.log(len(words) + 1), "word_length": len(t) / n,
        "upper": sum(unicodedata.category(c) == "Lu" for c in t) / chars, "digits": sum("0" <= c <= "9" for c in t) / chars,
        "symbols": sum(o and c not in ".," for o, c in zip(odd, t, strict=True)) / chars, "symbol_runs": runs / n,
        "stops": sum(c in ".," for c in t) / n, "spaced_symbols": spaced / n, "wide": len(t.encode()) / chars,
        "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / len(lines), "line_length": math.log(len(t) / len(lines) + 1),
    }


def test_quality_scores_equal_plain_rules(spark, odd_dir):
    folder = "/root/testdata/sf0.01"
    model = rules.learn_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    assert model.rules
    for path in (odd_dir, folder):
        docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
        for row in rules.score_quality(docs, model).collect():
            stats = plain_statistics(row.text)
            total = model.intercept + sum(w for rule, w in model.rules if all((stats[model.names[i]] > v) == above for i, above, v in rule))
            assert abs(row.score - 1 / (1 + math.exp(-total))) < 1e-9, row.doc_id


def test_languages_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    from bayline.llm.language_query import op8_language_codes

    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    scored = op8_language_codes(spark, folder).join(truth, "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_language_model_beats_its_base_on_held_out_rows(spark):
    from bayline.llm.backoff_query import op9_backoff_scores

    row = op9_backoff_scores(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


class PlainBackoff:
    """The trigram model by its definition, over whole counts."""

    def __init__(self, texts):
        self.c, self.n, self.m = collections.Counter(), collections.Counter(), collections.Counter()
        for text in texts:
            words = [*text.lower().split(), "</s>"]
            self.c.update(words)
            self.n.update(zip(["</s>", *words], words, strict=False))
            self.m.update(zip(["</s>", *words], words, words[1:], strict=False))
        self.total, self.distinct = sum(self.c.values()), len(self.c)
        self.left: dict = {}

    def uni(self, w):
        return (self.c[w] + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def prob(self, w, *history):
        if not history:
            return self.uni(w)
        counts, size = (self.m, self.n[history]) if len(history) == 2 else (self.n, self.c[history[0]])
        if counts[(*history, w)] > 1:
            return (counts[(*history, w)] - 0.5) / size
        return self.backoff(history) * self.prob(w, *history[1:])

    def backoff(self, history):
        if history not in self.left:
            counts, size = (self.m, self.n[history]) if len(history) == 2 else (self.n, self.c[history[0]])
            arcs = [(k[-1], v) for k, v in counts.items() if k[:-1] == history and v > 1]
            over = 1 - sum(self.prob(w, *history[1:]) for w, _ in arcs)
            self.left[history] = (1 - sum(v - 0.5 for _, v in arcs) / size) / over if arcs else 1.0
        return self.left[history]

    def score(self, text):
        history, out = ("</s>",), 0.0
        for w in [*text.lower().split(), "</s>"]:
            out += np.log10(self.prob(w, *history))
            history = (*history, w)[-2:]
        return out


def test_plain_backoff_probabilities_add_up():
    plain = PlainBackoff(["a b a c a b d e" if i % 2 else "b a b e" for i in range(40)])
    for history in [(), ("a",), ("b",), ("</s>",), ("a", "b"), ("</s>", "b"), ("c", "a"), ("x",)]:
        assert sum(plain.prob(w, *history) for w in [*plain.c, "unseen"]) == pytest.approx(1, abs=1e-9)


def test_every_language_is_sampled(spark):
    from bayline.llm.linear import sample_each

    rows = spark.range(103_000).selectExpr("id as doc_id", "case when id < 1000 then concat('rare', id div 10) else concat('l', id % 3) end as lang")
    counts = dict(sample_each(rows, "lang", "doc_id", language.PER_LANGUAGE, language.SAMPLE, language.LEAST).groupBy("lang").count().collect())
    assert len(counts) == 103 and set(counts.values()) == {10, 23}
    few = dict(sample_each(rows.where("doc_id >= 1000"), "lang", "doc_id", 600, 2400, 20).groupBy("lang").count().collect())
    assert few == {"l0": 600, "l1": 600, "l2": 600}


def test_scores_equal_a_plain_walk_over_many_blocks(spark, monkeypatch):
    from bayline.llm import backoff

    monkeypatch.setattr(backoff, "BLOCK", 1 << 14)  # many blocks and slices
    monkeypatch.setattr(backoff, "RUN", 16)
    rng = random.Random(4)
    filler = [" ".join(f"F{rng.randrange(60)}" for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts = [*filler, "rare bird", "other thing", "rare bird sings", "rare thing", "the rare bird sings", "a rare bird sings", "rare bird", "", "x y z"]
    training = [i % 7 != 0 for i in range(len(filler))] + [True] * (len(texts) - len(filler) - 5) + [False] * 5
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, training, strict=True)), "doc_id long, text string, training boolean").repartition(3)
    found = {r.doc_id: r for r in backoff.score_texts(docs, F.col("training")).collect()}
    plain = PlainBackoff([t for t, used in zip(texts, training, strict=True) if used])
    assert set(found) == set(range(len(texts))) and sum(v > 1 for v in plain.m.values()) > 100
    for i, text in enumerate(texts):
        words = [*text.lower().split(), "</s>"]
        assert found[i].score == pytest.approx(plain.score(text), abs=1e-6) and found[i].train_tokens == plain.total
        assert found[i].base_score == pytest.approx(sum(np.log10(plain.uni(w)) for w in words), abs=1e-6)
    i = texts.index("a rare bird sings")
    assert found[i].score > found[i].base_score + 3  # known as pairs and a triple


def kinds_table(spark, n=400):
    rng = random.Random(2)
    kinds = {"good": "alpha beta gamma delta", "poor": "zip zap zop zup", "toxic": "grr brr hrr trr"}
    rows = []
    for i, k in enumerate(rng.choices(list(kinds), [6, 3, 1], k=n)):
        other = rng.choice(list(kinds)) if i % 7 == 0 else k  # some documents are of two kinds
        words = [rng.choice(kinds[rng.choice([k, other])].split()) for _ in range(rng.randint(5, 40))]
        rows.append((i, k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, domain string, text string")


def expected_tokens(mixed, model):
    rows = mixed.collect()
    return [sum(r.rate * r.n_tokens * r.posterior[i] for r in rows) for i in range(len(model.domains))], rows


def test_mixture_meets_its_targets(spark):
    df = kinds_table(spark)
    labels = df.where("doc_id % 2 = 0").select("doc_id", "domain")
    for targets in ({"good": 0.5, "poor": 0.3, "toxic": 0.2}, {"good": 0.7, "poor": 0.29, "toxic": 0.01}):
        mixed, model, rates = mixing.mix(df, labels, targets)
        got, rows = expected_tokens(mixed, model)
        total = sum(r.n_tokens for r in rows)
        assert rates.converged and got == pytest.approx([targets[d] * total for d in model.domains], abs=1e-6 * total)
        assert got == pytest.approx(rates.reached, rel=1e-9) and min(r.rate for r in rows) >= 0
        copies = sum(r.copies * r.n_tokens for r in rows)
        assert copies == pytest.approx(total, rel=0.1)


def test_rates_stand_at_zero_where_the_bound_binds(spark):
    df = kinds_table(spark)
    mixed, model, rates = mixing.mix(df, df.select("doc_id", "domain"), {"good": 0.95, "poor": 0.045, "toxic": 0.005})
    got, rows = expected_tokens(mixed, model)
    assert rates.converged and len(rates.steps) > 1 and sum(r.rate == 0 for r in rows) > 5
    assert got == pytest.approx(rates.targets, abs=1e-6 * rates.total)


def test_thinning_meets_its_targets_and_impossible_ones_are_flagged(spark):
    df = kinds_table(spark)
    labels = df.select("doc_id", "domain")
    mixed, model, rates = mixing.mix(df, labels, mixing.thinned("toxic", 0.05), max_rate=1.0)
    got, rows = expected_tokens(mixed, model)
    likely = [r.posterior[model.domains.index("toxic")] > 0.5 for r in rows]
    plain = [sum((0.05 if t else 1) * r.n_tokens * r.posterior[i] for r, t in zip(rows, likely, strict=True)) for i in range(3)]
    assert rates.converged and rates.targets == pytest.approx(plain) and got == pytest.approx(plain, abs=1e-6 * rates.total)
    assert all(0 <= r.rate <= 1 for r in rows)
    with pytest.warns(UserWarning, match="misses its targets"):
        _, _, missed = mixing.mix(df, labels, {"good": 2.0, "toxic": 0.0}, max_rate=1.0)
    assert not missed.converged and missed.error > 0.1


def test_most_frequent_never_exceeds_its_bound(spark):
    counts = spark.range(1000).selectExpr("id", "1 + id % 37 as n")
    for bound in (0, 1, 30, 200, 5000):
        top = most_frequent(counts, bound)
        assert top.count() <= bound
        if bound == 200:
            assert top.agg(F.min("n")).first()[0] >= 28


def test_shards_hang_on_the_data_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key, before, found = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("3", "11"):
            spark.conf.set(key, partitions)
            found.append(sorted(tuple(r) for r in shards.schedule(docs.repartition(int(partitions)), 8).collect()))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1]
