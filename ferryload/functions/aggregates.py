"""Aggregate expressions.

Only aggregates that Spark combines before the shuffle with a small buffer live
here, so a group that holds a third of all rows costs no more than any other.
Aggregates whose state grows with the group (median, mode, concatenation) are
jobs in :mod:`ferryload.operators.grouping`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryload.fixed_values import AVG_TOKENS, KPI_CHOICES, SUM_TOKENS
from ferryload.functions.classes import choices
from ferryload.functions.text import contains_any


def selection(fields: dict[str, list]) -> Column:
    """Condition of a field selection: every listed field has one of its values."""
    condition = F.lit(True)
    for field, values in fields.items():
        condition = condition & F.col(f"`{field}`").isin(list(values))
    return condition


def set_sum(value: Column, fields: dict[str, list]) -> Column:
    """A10: sum under a field selection."""
    return F.sum(F.when(selection(fields), value))


def set_count(fields: dict[str, list]) -> Column:
    """A10: count under a field selection."""
    return F.count_if(selection(fields))


def sum_if(condition: Column, value: Column, otherwise: float = 0) -> Column:
    """``Sum(If(c, x, 0))``."""
    return F.sum(F.when(condition, value).otherwise(F.lit(otherwise)))


def only(value: Column) -> Column:
    """The value when all known values are equal, else NULL (no distinct set is kept)."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def first_sorted_value(value: Column, by: Column) -> Column:
    """A5: value with the smallest sort weight; equal weights take the smallest value."""
    return F.min_by(value, F.when(by.isNotNull(), F.struct(by, value)))


def last_sorted_value(value: Column, by: Column) -> Column:
    """A5: value with the largest sort weight; equal weights take the largest value."""
    return F.max_by(value, F.when(by.isNotNull(), F.struct(by, value)))


def statistic(name: str, *values: Column) -> Column:
    """Aggregate by its load-script name."""
    known = {
        "sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max,
        "stdev": F.stddev_samp, "variance": F.var_samp, "correl": F.corr, "covar": F.covar_samp,
        "skew": F.skewness, "kurtosis": F.kurtosis,
    }
    return known[name.lower()](*values)


def sum_known(value: Column) -> Column:
    """Sum with missing values counted as 0."""
    return F.sum(F.coalesce(value, F.lit(0)))


def kpi_aggregation(entity_type: Column, names: Column, target_type: Column) -> Column:
    """Aggregation, confidence and reason of a measure or flag, as a struct.

    ``names`` is the lower-cased source and target name. Averages are tested
    before sums, because a margin rate must not be added up.
    """

    pick = choices(KPI_CHOICES, "aggregation_type", "confidence", "reason")
    flag = entity_type == "FLAG"
    return (
        F.when(flag & (F.upper(target_type) == "BOOLEAN"), pick["boolean flag"])
        .when(flag, pick["flag"])
        .when(contains_any(names, AVG_TOKENS), pick["rate"])
        .when(contains_any(names, SUM_TOKENS), pick["amount"])
        .otherwise(pick["other"])
    )
