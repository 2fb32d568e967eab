"""Schemas as arrays of (name, type, nullable): hashing and JSON forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "array<struct<name:string,type:string,nullable:boolean>>"
FIELDS_JSON = "struct<fields:array<struct<name:string,type:string,nullable:boolean>>>"


def schema_hash(fields: Column, sep: str = ",") -> Column:
    """SHA-256 of ``name:type:nullable`` joined by ``sep``."""
    text = F.transform(fields, lambda f: F.concat_ws(":", f["name"], f["type"], f["nullable"].cast("string")))
    return F.sha2(F.array_join(text, sep), 256)


def json_fields(text: Column) -> Column:
    """Fields out of ``{"fields": [...]}``."""
    return F.from_json(text, FIELDS_JSON)["fields"]


def fields_json(fields: Column) -> Column:
    """Fields as ``{"fields": [...]}``."""
    return F.to_json(F.struct(fields.alias("fields")))


def value_json(value: Column) -> Column:
    """A number as ``{"value": x}``."""
    return F.to_json(F.struct(value.alias("value")))


def json_value(text: Column) -> Column:
    """The number in ``{"value": x}``."""
    return F.get_json_object(text, "$.value").try_cast("double")


def is_widening(old: Column, new: Column) -> Column:
    """Type changes that keep every value (E6). Fixed values."""
    pairs = F.concat_ws(">", old, new)
    safe = pairs.isin("int>bigint", "float>double", "tinyint>int", "tinyint>bigint", "smallint>int", "smallint>bigint")
    text = ((old == "string") & new.startswith("varchar")) | ((new == "string") & old.startswith("varchar"))
    return safe | text
