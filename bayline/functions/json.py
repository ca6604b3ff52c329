"""JSON text: lists that may be malformed, key presence, truthiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_elements(text: Column) -> Column:
    """The elements of a JSON array as JSON texts; an empty array for anything else."""
    parsed = F.try_parse_json(text)
    items = F.from_json(F.when(F.schema_of_variant(parsed).startswith("ARRAY"), text), "array<string>")
    return F.coalesce(items, F.array().cast("array<string>"))


def has_key(element: Column, key: str) -> Column:
    """Whether a JSON object has the key, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(element), key), F.lit(False))


def truthy(element: Column, key: str) -> Column:
    """Whether the key's value is true, a number other than zero, or a text that is not empty."""
    value = F.get_json_object(element, f"$.{key}")
    number = value.try_cast("double")
    quoted = F.coalesce(F.try_variant_get(F.try_parse_json(element), f"$.{key}", "boolean"), F.lit(None).cast("boolean"))
    return F.coalesce(F.when(value.isNull() | (value == "") | (value == "[]") | (value == "{}"), False).when(number.isNotNull(), number != 0).when(quoted.isNotNull() & value.isin("true", "false"), value == "true").otherwise(True), F.lit(False))
