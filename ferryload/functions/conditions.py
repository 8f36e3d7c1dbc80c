"""Predicates and conditional values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryload.fixed_values import TEXT_COLUMN_SUFFIXES
from ferryload.functions.casting import cast_or_null


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    """``IF(c, a, b)``; an unknown condition takes the second branch."""
    return F.when(condition, then).otherwise(otherwise)


def is_null(value: Column) -> Column:
    """F23."""
    return value.isNull()


def first_known(*values: Column) -> Column:
    """``COALESCE``."""
    return F.coalesce(*values)


def is_text_column(name: str) -> bool:
    """Names whose values are text although scripts compare them with numbers."""
    return name.lower().endswith(tuple(suffix.lower() for suffix in TEXT_COLUMN_SUFFIXES))


def compare_with_number(name: str, operator: str, number: float) -> Column:
    """Compare a column with a number.

    For text columns ``= 0`` asks for missing text and every other comparison
    asks for text that is present. Other columns compare as they are.
    """
    column = F.col(f"`{name}`")
    if is_text_column(name):
        if operator in ("=", "==") and number == 0:
            return column.isNull() | (column == "")
        if operator in ("=", "=="):
            return cast_or_null(column, "double") == number
        return column.isNotNull() & (column != "")
    plain = {
        "=": column == number, "==": column == number, "<>": column != number, "!=": column != number,
        ">": column > number, "<": column < number, ">=": column >= number, "<=": column <= number,
    }
    return plain[operator]


def history_flag(month: Column, cutoff: str) -> Column:
    """P10: 1 for months up to the month of ``cutoff``, else 0."""
    return F.when(month <= F.trunc(F.lit(cutoff).cast("date"), "MM"), 1).otherwise(0)
