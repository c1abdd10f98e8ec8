"""Column functions over text and rates. All offsets are codepoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """How many words, split at Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def prefix(code: Column) -> Column:
    """A category's two leading digits; what has none stays whole."""
    return F.coalesce(F.nullif(F.regexp_extract(code, r"^\s*(\d{2})", 1), F.lit("")), code, F.lit(""))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; null where it is undefined or both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    out = F.to_json(F.struct(text.alias("a")))
    return F.substring(out, F.lit(6), F.length(out) - 6)


def numeric(value: Column) -> Column:
    """A number from a result cell; blank and "None" are null."""
    return F.nullif(F.nullif(value, F.lit("")), F.lit("None")).try_cast("double")
