"""Classification expressions over catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    AUTO_APPROVE_CONFIDENCE,
    CLASS_CALLS,
    COUNT_TOKENS,
    DATE_NAME,
    DATE_TOKENS,
    DECIMAL_TOKENS,
    DIMENSION_TOKENS,
    FLAG_TOKENS,
    KEY_TOKENS,
    KPI_THEMES,
    MEASURE_AGGREGATES,
    MEASURE_TOKENS,
    MONTH_NUMBER_NAME,
    NUMBER_FORMAT_TYPES,
    OTHER_THEME,
    ROLE_CHOICES,
    TYPE_CHOICES,
)
from ferryload.functions.text import contains_any


def has_tag(tags: Column, *names: str) -> Column:
    """Any of the tags is set, ignoring case."""
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.arrays_overlap(lowered, F.array(*[F.lit(n) for n in names]))


def field_category(name: Column, tags: Column, number_type: Column) -> Column:
    """Field class; the first class in this order that applies wins."""
    return (
        F.when(has_tag(tags, "$date", "$timestamp") | contains_any(name, DATE_TOKENS), "DATE_LIKE")
        .when(contains_any(name, KEY_TOKENS), "KEY_LIKE")
        .when(has_tag(tags, "$text", "$ascii"), "TEXT_LIKE")
        .when(contains_any(name, FLAG_TOKENS), "FLAG_LIKE")
        .when(has_tag(tags, "$numeric") | F.upper(number_type).isin(NUMBER_FORMAT_TYPES), "NUMERIC_LIKE")
        .otherwise("UNKNOWN")
    )


def choices(table: dict[str, tuple], *names: str) -> dict[str, Column]:
    """Rows of a fixed table as struct constants with the given field names."""
    return {
        key: F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)]) for key, row in table.items()
    }


def target_type(category: Column, name: Column, symbols: Column, decimals: Column) -> Column:
    """Struct of target type, conversion rule, confidence and reason for a field class."""
    pick = choices(TYPE_CHOICES, "target_type", "conversion_rule", "confidence", "reason")
    few_symbols = F.coalesce(symbols.try_cast("int") <= 2, F.lit(True))
    whole = contains_any(name, COUNT_TOKENS) | F.coalesce(decimals.try_cast("int") == 0, F.lit(False))
    flag, number = category == "FLAG_LIKE", category == "NUMERIC_LIKE"
    return (
        F.when(category == "DATE_LIKE", pick["date"])
        .when(category == "TEXT_LIKE", pick["text"])
        .when(category == "KEY_LIKE", pick["key"])
        .when(flag & contains_any(name, FLAG_TOKENS) & few_symbols, pick["clear flag"])
        .when(flag, pick["flag"])
        .when(number & whole, pick["count"])
        .when(number & contains_any(name, DECIMAL_TOKENS), pick["amount"])
        .when(number, pick["number"])
        .otherwise(pick["other"])
    )


def review_status(confidence: Column) -> Column:
    """Confident rows are approved without a review."""
    return F.when(confidence >= AUTO_APPROVE_CONFIDENCE, "AUTO_APPROVED").otherwise("NEEDS_REVIEW")


def date_storage(name: Column, used_in_month_shift: Column) -> Column:
    """How a date field is stored, judged by its name and its use in month arithmetic."""
    lowered = F.lower(name)
    return (
        F.when(lowered.rlike(MONTH_NUMBER_NAME), "integer_yyyymm")
        .when(used_in_month_shift, "unknown")
        .when(lowered.rlike(DATE_NAME), "date")
        .otherwise("unknown")
    )


def column_role(name: Column, tags: Column, category: Column, runtime_type: Column) -> Column:
    """K1: struct of entity type, confidence and reason of a column."""
    pick = choices(ROLE_CHOICES, "entity_type", "confidence", "reason")
    category, runtime = F.coalesce(category, F.lit("")), F.upper(F.coalesce(runtime_type, F.lit("")))
    dated = has_tag(tags, "$date", "$timestamp") | contains_any(name, DATE_TOKENS)
    return (
        F.when(dated | (category == "DATE_LIKE"), pick["date"])
        .when(contains_any(name, FLAG_TOKENS) | (runtime == "BOOLEAN_LIKE") | (category == "FLAG_LIKE"), pick["flag"])
        .when(contains_any(name, KEY_TOKENS) | (category == "KEY_LIKE"), pick["identifier"])
        .when(
            contains_any(name, MEASURE_TOKENS) | (category == "NUMERIC_LIKE") | runtime.isin("INTEGER", "DECIMAL"),
            pick["measure"],
        )
        .when((category == "TEXT_LIKE") | contains_any(name, DIMENSION_TOKENS), pick["dimension"])
        .otherwise(pick["other"])
    )


def kpi_theme(text: Column) -> Column:
    """K9: first theme with a token in the KPI's name, description or formula."""
    result = F.lit(OTHER_THEME)
    for theme, tokens in reversed(KPI_THEMES):
        result = F.when(contains_any(text, tokens), F.lit(theme)).otherwise(result)
    return result


def expression_class(expression: Column) -> Column:
    """Class of a chart expression, by the calls it contains.

    All calls hold a bracket, so text without one needs no search for them.
    """
    text = F.coalesce(expression, F.lit(""))
    result = F.when(text.contains("{<"), F.lit("set_analysis")).when(~text.contains("("), F.lit("expression"))
    for name, calls in CLASS_CALLS.items():
        result = result.when(contains_any(text, calls), F.lit(name))
    return result.otherwise(F.lit("expression"))


def aggregate_name(expression: Column) -> Column:
    """First aggregate named in an expression, upper case, NULL if there is none."""
    found = F.regexp_extract(F.lower(expression), r"\b(" + "|".join(MEASURE_AGGREGATES) + r")\b", 1)
    return F.when(found != "", F.upper(found))
