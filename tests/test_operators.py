"""Operators on worked examples and against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from bayline.functions import boxes
from bayline.operators import dedupe, layouts, matching, metrics, sampling, selection, temporal

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxed(spark, rows, names):
    """rows: (frame, id, (x1, y1, x2, y2))."""
    flat = [(f, i, float(0), *map(float, b)) for f, i, b in rows]
    df = spark.createDataFrame(flat, f"{names[0]} long, {names[1]} long, score double, {BOX}")
    return df.select(names[0], names[1], "score", F.struct("x1", "y1", "x2", "y2").alias("box"))


BAY, NEXT = (0, 0, 100, 200), (100, 0, 200, 200)


def associate(spark, slots, vehicles):
    s = boxed(spark, [(1, i, b) for i, b in enumerate(slots)], ("frame", "slot_id"))
    v = boxed(spark, [(1, i, b) for i, b in enumerate(vehicles)], ("frame", "vehicle_id"))
    links = matching.link_boxes(s, v, "frame")
    polygon = matching.link_polygons(s.withColumn("polygon", boxes.to_quad(F.col("box"))), v, "frame")
    key = lambda df: sorted((r.slot_id, r.vehicle_id, r.occupies, round(r.slot_coverage, 9)) for r in df.collect())
    assert key(links) == key(polygon)
    occupies = {v_: sorted(r.slot_id for r in links.where("occupies").collect() if r.vehicle_id == v_) for v_ in range(len(vehicles))}
    return links.collect(), occupies, sorted(r.vehicle_id for r in matching.unmapped(v, links, "frame").collect())


def test_association(spark):
    assert associate(spark, [BAY, NEXT], [(10, 20, 90, 190)])[1:] == ({0: [0]}, [])
    assert associate(spark, [BAY, NEXT], [(20, 10, 180, 195)])[1] == {0: [0, 1]}
    (link,), occupies, _ = associate(spark, [BAY], [(40, 140, 65, 190)])
    assert link.slot_coverage < 0.35 and link.vehicle_coverage > 0.9 and occupies == {0: [0]}
    assert associate(spark, [BAY], [(20, 140, 45, 190), (55, 140, 80, 190)])[1] == {0: [0], 1: [0]}
    assert associate(spark, [BAY], [(400, 400, 480, 560)])[2] == [0]
    assert associate(spark, [BAY], [(80, 180, 300, 400)])[2] == [0]


def test_tracks_need_two_sightings(spark):
    a, b = (0.1, 0.1, 0.2, 0.2), (0.70, 0.70, 0.76, 0.76)

    def confirmed(*frames):
        rows = [(1, n, i, *box) for n, frame in enumerate(frames) for i, box in enumerate(frame)]
        df = spark.createDataFrame(rows, f"camera long, no long, box_id long, {BOX}").select("camera", "no", "box_id", F.struct("x1", "y1", "x2", "y2").alias("box"))
        last = len(frames) - 1
        return [r.confirmed for r in matching.confirm_tracks(df, "camera", "no").where(F.col("no") == last).orderBy("box_id").collect()]

    assert confirmed([a]) == [True]
    assert confirmed([a], [a]) == [True]
    assert confirmed([a], [a], [a, b]) == [True, False]
    assert confirmed([a], [a], [], [a]) == [True]
    assert confirmed([a], [a], [(0.6, 0.6, 0.7, 0.7)]) == [False]


def test_layout_agreement(spark):
    strips = [(1, i, (10 * i, 0, 10 * i + 8, 20)) for i in range(15)]
    known = boxed(spark, strips, ("frame", "slot_id"))
    share = lambda rows: [r.agreement for r in matching.explained_share(boxed(spark, rows, ("frame", "box_id")), known, "frame", 0.30, 5).collect()]
    assert share(strips[:5]) == [1.0]
    assert share(strips[:1]) == [0.0]
    assert share([(1, i, (x, y + 500, z, w + 500)) for _, i, (x, y, z, w) in strips]) == [0.0]


def test_suppression_and_matching_against_plain_loops(spark):
    rng = random.Random(4)
    rows = [(f, 100 * f + i, rng.random(), x := rng.random() * 5, y := rng.random() * 5, x + 3, y + 3) for f in range(12) for i in range(rng.randint(0, 7))]
    df = spark.createDataFrame(rows, f"frame long, box_id long, score double, {BOX}").select("frame", "box_id", "score", F.struct("x1", "y1", "x2", "y2").alias("box"))

    def iou(a, b):
        w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0), max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return w * h / (18 - w * h)

    kept = set()
    for f in range(12):
        mine = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: -r[2]):
            if all(iou(r[3:], k[3:]) < 0.3 for k in mine):
                mine.append(r)
        kept |= {r[1] for r in mine}
    assert {r.box_id for r in matching.suppress(df, "frame", 0.3).collect()} == kept

    truth = df.where("box_id % 2 = 0")
    predicted = df.where("box_id % 2 = 1")
    expected = set()
    for f in range(12):
        left = sorted((r for r in rows if r[0] == f and r[1] % 2 == 0), key=lambda r: r[1])
        for p in sorted((r for r in rows if r[0] == f and r[1] % 2), key=lambda r: -r[2]):
            best = max(left, key=lambda t: iou(p[3:], t[3:]), default=None)
            if best is not None and iou(p[3:], best[3:]) >= 0.2:
                left.remove(best)
                expected.add((p[1], best[1]))
            else:
                expected.add((p[1], None))
        expected |= {(None, t[1]) for t in left}
    assert {(r.predicted_id, r.truth_id) for r in matching.match(predicted, truth, "frame", 0.2).collect()} == expected


def test_quarantine(spark):
    rows = [
        ("train", "train", "same", "0000000000000000"),
        ("train-unique", "train", "train-only", "3333333333333333"),
        ("validation", "validation", "valid", "1111111111111111"),
        ("holdout", "holdout", "same", "0000000000000000"),
    ]
    df = spark.createDataFrame(rows, "id string, partition string, digest string, hash string")
    found = {r.id: r for r in dedupe.quarantine(df, "id", "digest", "hash", "partition").collect()}
    assert {i for i, r in found.items() if r.kept} == {"train-unique", "validation", "holdout"}
    assert (found["train"].conflict_partition, found["train"].conflict_id) == ("holdout", "holdout")
    assert all(r.conflict_id is None for r in found.values() if r.kept)


def test_hamming_pairs_are_complete(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(6)]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id long, hash string")
    found = {(r.a, r.b): r.distance for r in dedupe.hamming_classes(df, "id", "hash").collect()}
    least = {v: values.index(v) for v in values}
    near = {(least[v], least[w]): (v ^ w).bit_count() for v in least for w in least if least[v] < least[w] and (v ^ w).bit_count() <= 3}
    assert found == near | {(least[v], i): 0 for i, v in enumerate(values) if least[v] < i}


def test_near_text_classes_see_whole_texts(spark, tmp_path):
    from bayline.functions import hashing
    from bayline.plans.comparisons import near_text_classes

    rng = random.Random(8)
    body = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    opening = "the same opening of sixty characters and more stands in all of these "
    texts = [" ".join(body), "Changed " + " ".join(body[1:]), opening + " ".join(body[:900]), opening + " ".join(body[1000:]), " ".join(body), None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    words = {w: int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for t in filter(None, texts) for w in t.lower().split()}
    expected = {}
    for t in filter(str.strip, filter(None, texts)):
        hashes = [words[w] for w in t.lower().split()]
        expected[t] = f"{sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)):016x}"
    found = dedupe.simhash(docs, "text").join(docs.select(hashing.content_key(F.col("text"), 64).alias("digest"), "text"), "digest").collect()
    assert {r.text: r.hash for r in found} == expected
    bits = lambda i, j: (int(expected[texts[i]], 16) ^ int(expected[texts[j]], 16)).bit_count()
    assert bits(0, 1) <= 3 < bits(2, 3)
    classes = {(r.a, r.b): r.distance for r in near_text_classes(spark, f"file://{tmp_path}").collect()}
    assert classes == {(0, 4): 0, (0, 1): bits(0, 1)}


def test_classes_of_equal_hashes_are_not_paired_off(spark):
    rows = [(i, f"{i % 2 * 7:016x}") for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, hash string")
    found = {(r.a, r.b): r.distance for r in dedupe.hamming_classes(df, "id", "hash").collect()}
    assert found == {(i % 2, i): 0 for i in range(2, 60)} | {(0, 1): 3}


def test_daily_metrics_take_all_readings(spark, sf_dir):
    from bayline.plans.comparisons import binary_metrics_by_day

    found = binary_metrics_by_day(spark, sf_dir).agg(F.sum("readings"), F.count_if(F.col("precision").isNull())).first()
    assert found[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count() and found[1] > 0


def test_smoothing(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.1, 0.95, 0.95, 0.95, 0.95])], "slot long, at long, p double")
    out = temporal.smooth(rows, "slot", "at", "p").orderBy("at").collect()
    assert [round(r.ema, 5) for r in out] == [0.1, 0.27, 0.542, 0.7052, 0.80312]
    assert [r.state for r in out] == [False] * 4 + [True] and [r.changed for r in out] == [False] * 4 + [True]
    medians = temporal.rolling_median(rows, "slot", ["at"], "p", 3).groupBy("slot").agg(
        F.array_sort(F.collect_list(F.struct("at", "median"))).alias("s")
    )
    native = medians.select(F.inline(temporal.fold(F.col("s"), temporal.Smoothing()))).orderBy("at").collect()
    assert [(r.at, round(r.ema, 9), r.state, r.changed) for r in native] == [(r.at, round(r.ema, 9), r.state, r.changed) for r in out]


def test_metrics(spark):
    df = spark.createDataFrame([(False, False), (False, True), (True, True), (True, False)], "t boolean, p boolean")
    counts = df.agg(*metrics.confusion(F.col("p"), F.col("t")))
    row = metrics.zero_metrics(counts).first()
    assert (row.accuracy, row.balanced_accuracy, row.specificity, row.fn) == (0.5, 0.5, 0.5, 1)
    empty = metrics.nullable_metrics(df.limit(0).agg(*metrics.confusion(F.col("p"), F.col("t")))).first()
    assert empty.accuracy is None and empty.f1 is None


def test_selection_and_sampling(spark):
    rows = spark.createDataFrame([("a", i, i / 10, i >= 6) for i in range(10)], "g string, id long, p double, t boolean")
    grid = selection.by_threshold(rows, [], "p", "t", 0.0, 0.1, 10)
    best = selection.best(grid.withColumn("ba", selection.balanced_accuracy()), [F.col("ba"), -F.col("i")], ["threshold"]).first()
    assert round(best.threshold, 6) == 0.6
    assert [r.id for r in sampling.even_spacing(rows, ["g"], ["id"], 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert [r.id for r in sampling.stride(rows, ["g"], ["id"], 3, 2).orderBy("id").collect()] == [0, 3]
    assert sampling.bottom_k(rows, ["g"], "id", 1, 3).count() == 3


def test_layout_choice(spark):
    rows = [
        (0, 0.0, 0, 0, 0.0, True, True, "reused_verified"), (1, 0.0, 9, 0, 0.0, False, False, "verification_required"),
        (2, 0.4, 9, 9, 0.1, False, True, "auto_detected"), (3, 0.1, 9, 9, 0.6, False, True, "auto_detected"),
        (4, 0.1, 9, 9, 0.1, False, True, "automatic_layout_unresolved"), (5, 0.0, 0, 0, 0.0, False, True, "insufficient_visual_evidence"),
    ]
    df = spark.createDataFrame(rows, "id int, agreement double, recalled int, detected int, confidence double, verified boolean, detector boolean, expected string")
    assert layouts.choose_layout(df).where("state <> expected").count() == 0


def test_camera_recognition(spark):
    images = spark.createDataFrame([(1, "0" * 16, 1920, 1080), (2, "f" * 16, 1920, 1080), (3, "0" * 16, 1080, 1920)], "image_id int, fingerprint string, width int, height int")
    stored = spark.createDataFrame([(7, "0" * 14 + "ff", 1280, 720), (8, "0" * 16, 1920, 1080)], "layout_id int, fingerprint string, width int, height int")
    assert [(r.image_id, r.layout_id) for r in layouts.recognise(images, stored).collect()] == [(1, 7)]


def test_calibration(spark):
    frames = [(0, f, 10 * f + i, 0.8, float(10 * i), 0.0, 10.0 * i + 8 + f * 0.1, 20.0) for f in range(5) for i in range(5) if not (i == 4 and f > 0)]
    df = spark.createDataFrame(frames, f"camera long, no long, box_id long, score double, {BOX}").select("camera", "no", "box_id", "score", F.struct("x1", "y1", "x2", "y2").alias("box"))
    found = matching.calibrate(df, "camera", "no").collect()
    assert len(found) == 4 and all(r.frames_seen == 5 for r in found)


def test_calibrated_layouts_read_all_frames(spark, tmp_path):
    from bayline.plans.scenes import calibrated_layouts

    # camera 7 at frame numbers 0 to 24: four slots, other ones from frame 10 on
    rows = [(100 * no + 7, k + 7 * (no >= 10), k, k + 1, 1.0, 0.1, 0.0, "A", "F") for no in range(25) for k in range(4)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    found = calibrated_layouts(spark, f"file://{tmp_path}").collect()
    assert sorted((r.camera, r.run, r.frames_seen, r.frames) for r in found) == [(2, run, n, n) for run, n in ((0, 10), (1, 10), (2, 5)) for _ in range(4)]


def test_interval_union_and_islands(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 5.0, 6.0)], "g int, low double, high double")
    assert temporal.union_length(rows, ["g"], "low", "high").first().covered == 4.0
    assert temporal.islands(rows, ["g"], "low", 1.5).select(F.max("island")).first()[0] == 1


def test_places_and_order_statistics(spark):
    from bayline.operators.ranks import with_places

    rng = random.Random(12)
    rows = [(i, rng.choice("abc") if i % 9 else None, rng.choice([None, 5.0, float(rng.randrange(40)), rng.random() * 1e6])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(3)
    found = {r.id: (r.k, r.n) for r in with_places(df, ["g"], ["v", "id"], "k", "n").collect()}
    stats = {r.g: r for r in metrics.order_statistics(df, ["g"], "v", {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "high": lambda n: n - 1}, bins=16).collect()}
    middle = {r.g: r.median for r in metrics.medians(df, ["g"], "v").collect()}
    for g in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [found[r[0]] for r in own] == [(i, len(own)) for i in range(len(own))]
        if g:
            values = sorted(r[2] for r in own if r[2] is not None)
            n = len(values)
            assert (stats[g].low, stats[g].mid, stats[g].high) == (values[0], values[n // 2], values[-1])
            assert middle[g] == (values[(n - 1) // 2] + values[n // 2]) / 2
    assert metrics.medians(df.limit(0), [], "v").count() in (0, 1)


def test_smoother_grid_equals_single_settings(spark):
    rng = random.Random(3)
    rows = [(s, n, rng.random(), rng.random() < 0.5, f"d{n % 2}") for s in range(4) for n in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "slot long, n long, p double, truth boolean, dataset string")
    found = {(r.dataset, r.setting): r for r in temporal.smooth_grid(df, "slot", "n", "p", "truth", "dataset").groupBy("dataset", "setting").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "transition_error"))).collect()}
    for k in (0, 13, 44, 80):
        counts, off = {}, 0
        for s in range(4):
            series = sorted(r for r in rows if r[0] == s)
            tracker = temporal.SlotState()
            states = [tracker.update(r[2], temporal.GRID[k])[1] for r in series]
            for r, state in zip(series, states, strict=True):
                key = (r[4], ("tp" if r[3] else "fp") if state else ("fn" if r[3] else "tn"))
                counts[key] = counts.get(key, 0) + 1
            changes = lambda x: sum(a != b for a, b in zip(x, x[1:], strict=False))
            off += abs(changes(states) - changes([r[3] for r in series]))
        for d in ("d0", "d1"):
            assert all(found[d, k][c] == counts.get((d, c), 0) for c in ("tp", "fp", "tn", "fn"))
        assert sum(found[d, k].transition_error for d in ("d0", "d1")) == off


def test_simhash_of_texts_against_a_plain_sum(spark, monkeypatch):
    """Long and short texts, odd blanks and letters, nulls; words are summed a few at a time, rows keep their columns and no text is read twice."""
    import hashlib
    import random
    import re

    from bayline.operators import dedupe
    from bayline.plans.catalogues import with_hash

    rng = random.Random(3)
    words = ["a", "Bb", "Été", "İx", "c d", "e f", "x\x1cy", "zz", "0"]
    texts = [None, "", " \t\n", "one", "one one", " Two\x0bwords\x0c", *("".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\r"]) for _ in range(n)) for n in (3, 254, 255, 256, 700, 70000))] * 2

    def plain(text):
        found = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
        sums = [0] * 64
        for w in found:
            h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
            sums = [s + (h >> i & 1) for i, s in enumerate(sums)]
        return f"{sum(1 << i for i, s in enumerate(sums) if 2 * s > len(found)):016x}" if found else None

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lower = {r.id: r.low for r in df.select("id", F.lower("text").alias("low")).collect()}
    expected = {i: (None if t is None else hashlib.sha256(t.encode()).hexdigest(), plain(lower[i])) for i, t in enumerate(texts)}
    hashed = with_hash(df, "text")
    assert {r.id: (r.digest, r.hash) for r in hashed.collect()} == expected and hashed.columns == ["id", "digest", "hash"]
    assert {tuple(r) for r in dedupe.simhash(df, "text").collect()} == {v for v in expected.values() if v[1]}
    plan = dedupe.hamming_classes(hashed, "id", "hash")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "split" not in plan  # texts were read once before, for each step again
    known = dedupe._WordHashes()
    monkeypatch.setattr(dedupe, "WORDS", 100)
    monkeypatch.setattr(dedupe, "KNOWN", 3)
    assert dedupe._simhashes([None if t is None else lower[i].encode() for i, t in enumerate(texts)], known) == [expected[i][1] for i in range(len(texts))]
    assert len(known) <= 3
