"""Readers of annotation files: JSON lines, catalogues, CSV, XML, parallel arrays, label texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayline.functions import polygons
from bayline.functions.text import capture_stem, occupancy_label

CORNERS = "array<array<double>>"
SLOT = f"struct<id:string,polygon:{CORNERS},occupied:boolean,geometry_area:double>"
SCENARIO = (
    "schema_version int, id string, dataset string, lot string, condition string, split string, image_path string, image_width int, image_height int,"
    f" total_spaces int, occupied_spaces int, vacant_spaces int, source_sha256 string, perceptual_hash string, slots array<{SLOT}>"
)
#: The picture size that camera slot rectangles refer to.
CAMERA_WIDTH, CAMERA_HEIGHT = 2592.0, 1944.0


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line that is not blank; malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The scenarios of a catalogue document with their position; none if the file is missing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"position int, {SCENARIO}")
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in SCENARIO.split(", "))
    rows = spark.read.schema(f"schema_version int, scenarios array<struct<{fields}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("scenarios").alias("position", "s")).select("position", "s.*")


def camera_labels(spark: SparkSession, path: str) -> DataFrame:
    """camera, stem, slot_id and occupied of a label CSV; rows whose camera or slot is no number go."""
    rows = spark.read.schema("camera string, datetime string, occupancy string, slot_id string").option("header", True).csv(path)
    kept = rows.where(F.col("camera").rlike("^[0-9]+$") & F.col("slot_id").rlike("^[0-9]+$"))
    return kept.select(
        F.concat(F.lit("camera"), F.col("camera").cast("int").cast("string")).alias("camera"),
        capture_stem(F.col("datetime")).alias("stem"),
        F.col("slot_id").cast("int").alias("slot_id"),
        occupancy_label(F.col("occupancy")).alias("occupied"),
    )


def camera_geometry(spark: SparkSession, path: str) -> DataFrame:
    """camera (from the file's name), slot_id and quad of rectangle CSVs."""
    rows = spark.read.schema("SlotId int, X double, Y double, W double, H double").option("header", True).csv(path)
    quad = polygons.rectangle_quad(F.col("X"), F.col("Y"), F.col("W"), F.col("H"), CAMERA_WIDTH, CAMERA_HEIGHT)
    return rows.select(F.regexp_extract("_metadata.file_name", "^([A-Za-z]+[0-9]+)", 1).alias("camera"), F.col("SlotId").alias("slot_id"), quad.alias("quad"))


def xml_slots(spark: SparkSession, path: str) -> DataFrame:
    """path, slot_id, occupied (null if unlabelled) and pairs of the space elements of XML files."""
    schema = "_id string, _occupied string, contour struct<point array<struct<_x double, _y double>>>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "space").load(path)
    pairs = F.transform("contour.point", lambda p: F.array(p["_x"], p["_y"]))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_id").alias("slot_id"), occupancy_label(F.col("_occupied")).alias("occupied"), pairs.alias("pairs"))


def labelled_slots(slots: DataFrame) -> DataFrame:
    """Per file the labelled slots, their states, and how many have no label."""
    known = F.col("occupied").isNotNull()
    return slots.groupBy("path").agg(
        F.count_if(known).alias("total_spaces"), F.count_if("occupied").alias("occupied_spaces"), F.count_if(~F.col("occupied")).alias("vacant_spaces"), F.count_if(~known).alias("unlabelled")
    )


def parallel_annotations(spark: SparkSession, path: str) -> DataFrame:
    """split, file_name, slot_id from 1, pairs and occupied of a document of parallel arrays.

    Arrays of unequal length fail: they would pair names with others' slots.
    """
    part = f"struct<file_names:array<string>,rois_list:array<array<{CORNERS}>>,occupancy_list:array<array<boolean>>>"
    document = spark.read.schema(f"train {part}, valid {part}, test {part}").option("multiLine", True).json(path)
    parts = F.array(*(F.struct(F.lit(n).alias("split"), F.col(n).alias("v")) for n in ("train", "valid", "test")))
    rows = document.select(F.inline(F.filter(parts, lambda p: p.v.isNotNull())))
    same = lambda *sizes: F.array_min(F.array(*sizes)) == F.array_max(F.array(*sizes))
    fail = lambda what: F.raise_error(F.lit(f"{what} of unequal length"))
    zipped = F.arrays_zip(F.col("v.file_names").alias("f"), F.col("v.rois_list").alias("r"), F.col("v.occupancy_list").alias("o"))
    images = rows.select("split", F.explode(F.when(same(F.size("v.file_names"), F.size("v.rois_list"), F.size("v.occupancy_list")), zipped).otherwise(fail("image lists"))).alias("i"))
    slots = F.when(F.size("i.r") == F.size("i.o"), F.arrays_zip("i.r", "i.o")).otherwise(fail("slot lists"))
    numbered = images.select("split", F.col("i.f").alias("file_name"), F.posexplode(slots).alias("at", "s"))
    return numbered.select("split", "file_name", (F.col("at") + 1).alias("slot_id"), F.col("s.r").alias("pairs"), F.col("s.o").alias("occupied"))


def path_labels(spark: SparkSession, path: str) -> DataFrame:
    """path and occupied of lines like "some/patch.jpg 1"; other lines go."""
    lines = spark.read.text(path)
    found = r"^(\S.*\S|\S)\s+([01])$"
    return lines.where(F.col("value").rlike(found)).select(F.regexp_extract("value", found, 1).alias("path"), (F.regexp_extract("value", found, 2) == "1").alias("occupied"))


def detector_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, kind and the corners of label lines.

    A line is a class and eight numbers, or a class, a box and four corners with a visibility each;
    other lines go.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("v"))
    number = lambda i: F.col("v")[i].cast("double")
    corners = lambda start, step: F.array(*(polygons.point(number(start + step * i), number(start + 1 + step * i)) for i in range(4)))
    quad = F.when(F.size("v") == 9, corners(1, 2)).when(F.size("v") == 17, corners(5, 3))
    return lines.where(F.size("v").isin(9, 17)).select("file", F.col("v")[0].cast("int").alias("kind"), quad.alias("quad"))


def coco_boxes(spark: SparkSession, path: str, folded: DataFrame) -> DataFrame:
    """image_id, kind and box of a COCO document without its crowds; folded maps name to kind."""
    annotation = "struct<image_id:long,category_id:long,bbox:array<double>,iscrowd:int>"
    schema = f"annotations array<{annotation}>, categories array<struct<id:long,name:string>>"
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    names = document.select(F.inline("categories")).join(folded, "name").select(F.col("id").alias("category_id"), "kind")
    rows = document.select(F.inline("annotations")).where("coalesce(iscrowd, 0) = 0")
    b = F.col("bbox")
    box = F.struct(b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))
    return rows.join(names, "category_id").select("image_id", "kind", box.alias("box"))


def archive_inventory(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Whether each expected file (name, min_bytes) is there and large enough; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    joined = expected.join(files, "name", "left")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") < F.col("min_bytes"), "too_small").otherwise("ready")
    return joined.select("name", F.col("length").alias("bytes"), state.alias("state"))


def uploads(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Uploaded files with their digest and the kind that their first bytes show; too large ones are refused."""
    rows = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 12))
    kind = (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(F.substring(head, 9, 8) == "66747970", "video/mp4")
    )
    state = F.when(F.col("length") > most_bytes, "too_large").when(kind.isNull(), "unsupported").otherwise("accepted")
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), state.alias("state"))


def clamped_slots(slots: DataFrame, width: float, height: float) -> DataFrame:
    """xml_slots() with pixel corners as shares of the picture held in [0, 1]; slots without a label go."""
    share = lambda v, size: F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0))
    pairs = F.transform("pairs", lambda p: F.array(share(p[0], width), share(p[1], height)))
    return slots.where(F.col("occupied").isNotNull()).withColumn("pairs", pairs)


#: The sites that split lists name, under their canonical names.
SPLIT_SITES = {"PUC": "PUCPR", "PUCPR": "PUCPR", "UFPR04": "UFPR04", "UFPR05": "UFPR05"}


def split_lists(spark: SparkSession, path: str, sites: bool = True) -> DataFrame:
    """(site, day, partition) from split lists train.txt, val.txt and test.txt, whose lines are image paths.

    With sites, a path names its site in one of its folders, in any case; without, site is "day".
    A group that several lists name belongs to the last of train, validation and holdout. Lines
    without a day, or without a known site, go.
    """
    name = F.regexp_extract("_metadata.file_name", r"(train|val|test)\.txt$", 1)
    lines = spark.read.text(path).select(name.alias("list"), F.split("value", "/").alias("parts"))
    day = F.try_element_at(F.filter("parts", lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(1))
    pairs = [F.lit(v) for pair in SPLIT_SITES.items() for v in pair]
    known = F.filter("parts", lambda p: F.upper(p).isin(*SPLIT_SITES))
    site = F.try_element_at(F.create_map(*pairs), F.upper(F.try_element_at(known, F.lit(1)))) if sites else F.lit("day")
    rank = F.when(F.col("list") == "train", 0).when(F.col("list") == "val", 1).when(F.col("list") == "test", 2)
    rows = lines.select(site.alias("site"), day.alias("day"), rank.alias("rank")).dropna()
    last = rows.groupBy("site", "day").agg(F.max("rank").alias("rank"))
    return last.select("site", "day", F.element_at(F.array(*map(F.lit, ("train", "validation", "holdout"))), F.col("rank") + 1).alias("partition"))
