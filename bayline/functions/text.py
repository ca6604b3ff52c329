"""Text keys: slugs, safe names, labels, camera identities, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(x: Column) -> Column:
    """Lower case, runs of other than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_name(x: Column, fallback: str = "upload", limit: int = 180) -> Column:
    """The leaf of a path with anything but letters, digits, dots, spaces, hyphens and underscores replaced."""
    clean = F.regexp_replace(F.regexp_replace(leaf(x), "[^A-Za-z0-9._ -]+", "_"), "^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, limit), F.lit("")), F.lit(fallback))


def safe_relative_path(x: Column) -> Column:
    """Whether a path is relative and has no empty, . or .. part."""
    parts = F.split(F.regexp_replace(x, r"\\", "/"), "/")
    return (F.length(x) > 0) & ~x.rlike("^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def occupancy_label(x: Column) -> Column:
    """true for 1, false for 0, null (unlabelled) for anything else."""
    return F.when(F.trim(x) == "1", True).when(F.trim(x) == "0", False)


def capture_stem(moment: Column) -> Column:
    """2015-11-12_07.09 as the image stem 2015-11-12_0709."""
    return F.replace(moment, F.lit("."), F.lit(""))


#: How ids carry the time of a capture, at their end or anywhere.
CAPTURE_AT_END = r"(\d{4}-\d{2}-\d{2})_(\d{2})[._-]?(\d{2})(?:[._-]?\d{2})?$"
CAPTURE_ANYWHERE = r"(\d{4}-\d{2}-\d{2})[_/](\d{2})[._-]?(\d{2})"


def capture_key(source: Column, pattern: str = CAPTURE_AT_END) -> Column:
    """Day, hour and minute of an id as a text that sorts by time; the id itself without them."""
    key = F.concat(*(F.regexp_extract(source, pattern, i) for i in (1, 2, 3)))
    return F.when(source.rlike(pattern), key).otherwise(source)


def leaf(path: Column) -> Column:
    """The last part of a path, so that reports show no folders."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def camera_identity(dataset: Column, group_id: Column, source_id: Column) -> Column:
    """dataset:first part of the group; where groups name no camera, dataset:source."""
    return F.when(dataset == "ACPDS", F.concat_ws(":", dataset, source_id)).otherwise(F.concat_ws(":", dataset, F.split_part(group_id, F.lit("/"), F.lit(1))))


#: Detector labels and the product class of each.
VEHICLE_CLASSES = {
    "car": "CAR",
    "motorcycle": "TWO_WHEELER",
    "truck": "TRUCK",
    "suv": "CAR",
    "van": "CAR",
    "minivan": "CAR",
    "hatchback": "CAR",
    "sedan": "CAR",
    "pickup": "TRUCK",
    "lorry": "TRUCK",
    "scooter": "TWO_WHEELER",
    "motorbike": "TWO_WHEELER",
    "moped": "TWO_WHEELER",
}


def vehicle_class(x: Column) -> Column:
    """CAR, TWO_WHEELER, TRUCK, or null for anything else."""
    pairs = [F.lit(v) for pair in VEHICLE_CLASSES.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(x)))
