"""Readers and writers on small files; the stream against the batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bayline.operators import temporal
from bayline.sources import annotations, reports
from bayline.streaming.hysteresis import smooth_stream, windowed_counts


def test_json_lines_skip_blank_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    rows = annotations.json_lines(spark, f"file://{path}", "id string, n int").collect()
    assert sorted((r.id, r.n) for r in rows) == [("a", 1), ("b", None)]


def test_catalogue_is_empty_when_missing(spark, tmp_path):
    assert annotations.catalogue(spark, f"file://{tmp_path}/none.json").count() == 0
    path = tmp_path / "catalogue.json"
    path.write_text(json.dumps({"schema_version": 1, "scenarios": [{"id": "x", "dataset": "D", "slots": [{"id": "1", "polygon": [[0.1, 0.2]], "occupied": True}]}, {"id": "y"}]}))
    rows = annotations.catalogue(spark, f"file://{path}").orderBy("position").collect()
    assert [r.id for r in rows] == ["x", "y"] and rows[0].slots[0].occupied


def test_camera_csvs_join(spark, tmp_path):
    (tmp_path / "camera1.csv").write_text("SlotId,X,Y,W,H\n1,100,100,200,300\n")
    (tmp_path / "labels.csv").write_text("camera,datetime,occupancy,slot_id\n01,2015-11-12_07.09,0,1\nx,2015-11-12_07.09,0,1\n")
    labels = annotations.camera_labels(spark, f"file://{tmp_path}/labels.csv")
    geometry = annotations.camera_geometry(spark, f"file://{tmp_path}/camera1.csv")
    row = labels.join(geometry, ["camera", "slot_id"]).first()
    assert (row.camera, row.stem, row.occupied) == ("camera1", "2015-11-12_0709", False)
    assert row.quad[2].x == pytest.approx(300 / 2592) and row.quad[2].y == pytest.approx(400 / 1944)


def test_xml_slots_without_label_are_counted(spark, tmp_path):
    space = lambda i, o: f'<space id="{i}" {o}><contour><point x="1" y="2"/><point x="3" y="4"/></contour></space>'
    path = tmp_path / "a.xml"
    path.write_text(f"<parking>{space(1, 'occupied=\"1\"')}{space(2, 'occupied=\"0\"')}{space(3, '')}</parking>")
    slots = annotations.xml_slots(spark, f"file://{path}")
    assert sorted((r.slot_id, r.occupied) for r in slots.collect()) == [("1", True), ("2", False), ("3", None)]
    total = annotations.labelled_slots(slots).first()
    assert (total.total_spaces, total.occupied_spaces, total.vacant_spaces, total.unlabelled) == (2, 1, 1, 1)


def test_parallel_arrays_must_have_equal_length(spark, tmp_path):
    roi = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"train": {"file_names": ["a.jpg"], "rois_list": [[roi, roi]], "occupancy_list": [[True, False]]}}))
    rows = annotations.parallel_annotations(spark, f"file://{path}").orderBy("slot_id").collect()
    assert [(r.split, r.file_name, r.slot_id, r.occupied) for r in rows] == [("train", "a.jpg", 1, True), ("train", "a.jpg", 2, False)]
    path.write_text(json.dumps({"train": {"file_names": ["a.jpg"], "rois_list": [[roi, roi]], "occupancy_list": [[True]]}}))
    with pytest.raises(Exception, match="unequal length"):
        annotations.parallel_annotations(spark, f"file://{path}").collect()


def test_label_lines_round_trip(spark, tmp_path):
    quad = [[0.1, 0.1], [0.3, 0.1], [0.3, 0.2], [0.1, 0.2]]
    rows = spark.createDataFrame([("train", "a", 0, quad), ("train", "b", 0, quad[:3])], "split string, image string, kind int, pairs array<array<double>>")
    counts = reports.write_label_lines(rows, f"file://{tmp_path}/labels").first()
    assert (counts.kept, counts.skipped) == (1, 1)
    back = annotations.detector_labels(spark, f"file://{tmp_path}/labels/split=train/image=a").first()
    assert [(p.x, p.y) for p in back.quad] == [tuple(p) for p in quad]
    pose = rows.limit(1).select(reports.label_text(F.col("kind"), F.transform("pairs", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))), "pose").alias("t")).first().t
    assert pose.split()[:8] == ["0", "0.200000", "0.150000", "0.200000", "0.100000", "0.100000", "0.100000", "2.000000"]
    (tmp_path / "pose.txt").write_text(pose)
    assert [(p.x, p.y) for p in annotations.detector_labels(spark, f"file://{tmp_path}/pose.txt").first().quad] == [tuple(p) for p in quad]


def test_coco_crowds_and_unknown_classes_go(spark, tmp_path):
    path = tmp_path / "coco.json"
    boxes = [{"image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4], "iscrowd": 0}, {"image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4], "iscrowd": 1}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}]
    path.write_text(json.dumps({"annotations": boxes, "categories": [{"id": 3, "name": "car"}, {"id": 9, "name": "dog"}]}))
    folded = spark.createDataFrame([("car", "CAR")], "name string, kind string")
    rows = annotations.coco_boxes(spark, f"file://{path}", folded).collect()
    assert [(r.kind, r.box.x2, r.box.y2) for r in rows] == [("CAR", 4.0, 6.0)]


def test_path_labels_archives_and_uploads(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a/b c.jpg 1\nbroken\nd.jpg 0\n")
    assert [(r.path, r.occupied) for r in annotations.path_labels(spark, f"file://{tmp_path}/l.txt").collect()] == [("a/b c.jpg", True), ("d.jpg", False)]
    (tmp_path / "up").mkdir()
    (tmp_path / "up/x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    (tmp_path / "up/y.bin").write_bytes(b"zz")
    states = {r.path.split("/")[-1]: (r.kind, r.state) for r in annotations.uploads(spark, f"file://{tmp_path}/up", 1000).collect()}
    assert states == {"x.png": ("image/png", "accepted"), "y.bin": (None, "unsupported")}
    wanted = spark.createDataFrame([("x.png", 5), ("y.bin", 5), ("z", 1)], "name string, min_bytes long")
    found = {r.name: r.state for r in annotations.archive_inventory(spark, f"file://{tmp_path}/up", wanted).collect()}
    assert found == {"x.png": "ready", "y.bin": "too_small", "z": "missing"}


def test_reports(spark, tmp_path):
    runs = spark.createDataFrame([(1, "A", 3, "extra")], "id int, dataset string, total_spaces int, other string")
    reports.write_run_csv(runs, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/csv")
    assert back.columns == reports.REPORT_COLUMNS and back.first().total_spaces == "3"
    reports.write_json_report(runs, f"file://{tmp_path}/json")
    text = "".join(r.value for r in spark.read.text(f"file://{tmp_path}/json").collect())
    assert json.loads(text)["dataset"] == "A"
    assert reports.additive(runs, runs.select("id").withColumn("new", F.lit(1))).columns == ["id", "dataset", "total_spaces", "other", "new"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(s, t, rng.random()) for t in range(30) for s in range(4)]
    schema = "slot long, at long, p double"
    for k in range(3):
        part = [r for r in rows if r[1] // 10 == k]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    query = smooth_stream(stream, "slot", "at", "p").writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    key = lambda df: sorted((r.slot, r.at, round(r.ema, 9), r.state, r.changed) for r in df.collect())
    assert key(spark.table("smoothed")) == key(temporal.smooth(spark.createDataFrame(rows, schema), "slot", "at", "p"))


def test_windowed_counts_in_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("busy", F.col("value") > 50)
    counted = windowed_counts(events, "ts", "event_type", "busy")
    assert counted.agg(F.sum("readings")).first()[0] == events.count()
