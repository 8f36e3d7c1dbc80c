"""Number expressions (F20, F21, F29, A14) and the coercions of the conversion rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryload.fixed_values import FALSE_WORDS, TARGET_TYPES, TRUE_WORDS
from ferryload.functions.casting import NUMBER_TEXT, WHOLE_TEXT, cast_or_null
from ferryload.functions.dates import serial_to_date

def floor(value: Column) -> Column:
    """F20."""
    return F.floor(value)


def ceil(value: Column) -> Column:
    """F20."""
    return F.ceil(value)


def round_to(value: Column, digits: int = 0) -> Column:
    """F20."""
    return F.round(value, digits)


def num(value: Column, target: str = "int") -> Column:
    """``Num(x)``; values that do not read as ``target`` give NULL."""
    return cast_or_null(value, target)


def text_number(value: Column) -> Column:
    """a text-typed column as an operand of arithmetic."""
    return cast_or_null(value.cast("string"), "double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL when the denominator is 0."""
    return F.try_divide(numerator, denominator)


def reads_as_number(text: Column) -> Column:
    """Profile rule: the text is a decimal number."""
    return text.rlike(NUMBER_TEXT)


def reads_as_whole_number(text: Column) -> Column:
    """Profile rule: the text is a number without a fractional part."""
    double = cast_or_null(text, "double")
    return text.rlike(WHOLE_TEXT) | (text.rlike(NUMBER_TEXT) & (double == F.floor(double)))


def to_bigint(value: Column) -> Column:
    """Whole numbers in any spelling (``2``, ``2.0``); everything else NULL."""
    text = value.cast("string")
    exact = cast_or_null(text, "decimal(38,18)")
    whole = exact.try_cast("bigint")
    # a fraction too small for 18 places still shows in the double
    return F.when((exact == whole) & ((whole != 0) | (cast_or_null(text, "double") == 0)), whole)


def to_double(value: Column) -> Column:
    """T7."""
    return cast_or_null(value.cast("string"), "double")


def to_decimal_18_2(value: Column) -> Column:
    """Half-up to two places."""
    return cast_or_null(value.cast("string"), "decimal(18,2)")


def flag_to_boolean(value: Column) -> Column:
    """Truth words in any case; anything else NULL."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def convert(value: Column, rule: str, target_type: str) -> Column:
    """Apply one conversion rule (T5-T11). An unknown rule keeps the value as text."""
    rule, target = (rule or "").strip(), (target_type or "").strip().upper()
    if rule == "cast_bigint":
        return to_bigint(value)
    if rule == "cast_double":
        return to_double(value)
    if rule == "cast_decimal_18_2":
        return to_decimal_18_2(value)
    if rule == "qlik_serial_to_date":
        return serial_to_date(value.cast("string"))
    if rule == "flag_to_boolean_or_int_review":
        return flag_to_boolean(value) if target == "BOOLEAN" else to_bigint(value)
    return value.cast("string")


KNOWN_RULES = [
    "cast_string", "cast_bigint", "cast_double", "cast_decimal_18_2", "qlik_serial_to_date",
    "flag_to_boolean_or_int_review",
]


def spark_type(target_type: str) -> str:
    """Spark type of a target type; names outside the contract become text."""
    name = (target_type or "STRING").strip().upper()
    extra = {"FLOAT": "float", "INTEGER": "int", "LONG": "bigint", "BINARY": "binary",
             "TINYINT": "tinyint", "SMALLINT": "smallint"}
    return name.lower() if name in TARGET_TYPES else extra.get(name, "string")


def typed(value: Column, target_type: str) -> Column:
    """Cast that nulls unreadable cells instead of stopping the load."""
    return cast_or_null(value, spark_type(target_type))
