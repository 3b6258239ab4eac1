"""Validation of records of strings against a declared schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "String"  # String, Int, Float, Bool, Bytes
    required: bool = False
    default: str | None = None


def fits(value: Column, kind: str) -> Column:
    """Whether a text is of a kind. Int: sign and digits within 64 bits. Float: also exponents, inf and nan.
    No spaces or type suffixes, which Spark's own casts would take."""
    if kind == "Int":
        return value.rlike(r"^[+-]?[0-9]+\z") & value.try_cast("bigint").isNotNull()
    if kind == "Float":
        return value.rlike(r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z")
    if kind == "Bool":
        return value.isin("true", "false", "0", "1")
    if kind == "String":
        return F.is_valid_utf8(value)
    return F.lit(True)


def errors(fields: list[Field]) -> Column:
    """An array of (field, message); fields that the schema does not name are ignored."""
    found = []
    for f in fields:
        value = F.col(f.name)
        row = lambda text, name=f.name: F.struct(F.lit(name).alias("field"), F.lit(text).alias("message"))
        missing = F.lit(f.required and f.default is None) & value.isNull()
        wrong = value.isNotNull() & ~fits(value, f.kind)
        found.append(F.when(missing, row(f"field '{f.name}' is required")).when(wrong, row(f"field '{f.name}': expected {f.kind}, got invalid data")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def validate(records: DataFrame, fields: list[Field]) -> DataFrame:
    return records.withColumn("errors", errors(fields))


def apply_defaults(records: DataFrame, fields: list[Field]) -> DataFrame:
    """Fills absent fields only."""
    return records.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(f.default)) for f in fields if f.default is not None})
