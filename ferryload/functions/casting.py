"""Casts that null unreadable cells, without paying for them.

A failing ``try_cast`` of text costs up to fifty times a good one, because Spark
raises and catches an error per cell. A pattern test in front keeps dirty columns cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that reads as a decimal number, and as a whole number.
NUMBER_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
WHOLE_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"


def readable_as(value: Column, target: str) -> Column:
    """The value, or NULL where it is text that cannot be read as the target type."""
    kind = target.lower()
    if kind in ("tinyint", "smallint", "int", "integer", "bigint", "long"):
        pattern = INTEGER_TEXT
    elif kind in ("float", "double") or kind.startswith("decimal"):
        pattern = NUMBER_TEXT
    else:
        return value
    # The type test is a constant once the column is known, so other types skip the pattern.
    return F.when((F.typeof(value) != "string") | value.cast("string").rlike(pattern), value)


def cast_or_null(value: Column, target: str) -> Column:
    """``try_cast`` with the pattern test in front."""
    return readable_as(value, target).try_cast(target)
