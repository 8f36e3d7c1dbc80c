"""Source-to-target reconciliation.

All metrics of one grain are aggregated in one pass per side; the two results have
one row per grain key and are joined on it, NULL keys included.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    COMPARISON_TYPE,
    EXPECTED_TOTAL_TOLERANCE,
    MAJOR_DIMENSION_TOKENS,
    TOLERANCE,
    TOLERANCE_TEXT,
)
from ferryload.functions.aggregates import sum_known
from ferryload.functions.text import snake_words
from ferryload.operators.joins import full_on_grain


def _sides(source: DataFrame, target: DataFrame, metrics: dict[str, Column], grain: dict[str, Column]) -> DataFrame:
    def side(df: DataFrame, prefix: str) -> DataFrame:
        keys = [value.alias(name) for name, value in grain.items()]
        aggregates = [agg.cast("double").alias(f"{prefix}_{name}") for name, agg in metrics.items()]
        return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)

    left, right = side(source, "s"), side(target, "t")
    if grain:
        return full_on_grain(left, right, list(grain))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def compare(
    source: DataFrame, target: DataFrame, metrics: dict[str, Column], grain: dict[str, Column] | None = None
) -> DataFrame:
    """Metrics on both sides with variance and verdict, overall or per grain key."""
    grain = grain or {}
    both = _sides(source, target, metrics, grain)
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric_name"), F.col(f"s_{m}").alias("source_value"), F.col(f"t_{m}").alias("target_value"))
        for m in metrics
    ])
    long = both.select(*grain, F.explode(rows).alias("m")).select(*grain, "m.*")
    difference = F.col("target_value") - F.col("source_value")
    share = F.try_divide(difference, F.col("source_value"))
    return long.select(
        *grain, "metric_name", "source_value", "target_value",
        difference.alias("absolute_variance"), share.alias("percentage_variance"),
        verdict(F.col("source_value"), F.col("target_value")).alias("status"),
    )


def verdict(source: Column, target: Column) -> Column:
    """Equal (also both missing) or within the percentage tolerance passes."""
    share = F.abs(F.try_divide(target - source, source))
    close = source.eqNullSafe(target) | F.coalesce(share <= TOLERANCE, F.lit(False))
    return F.when(close, "passed").otherwise("failed")


def compare_by_month(source: DataFrame, target: DataFrame, metrics: dict[str, Column], date: str) -> DataFrame:
    """R2: monthly comparison."""
    return compare(source, target, metrics, {"reconciliation_month": F.trunc(F.col(date), "MM")})


def compare_by_dimension(source: DataFrame, target: DataFrame, metrics: dict[str, Column], dimension: str) -> DataFrame:
    """Comparison per dimension value."""
    return compare(source, target, metrics, {dimension: F.col(dimension)})


def major_dimensions(dimensions: DataFrame) -> DataFrame:
    """The dimensions of a table whose names hold a major token."""
    name = F.lower("dimension")
    token = F.least(*[
        F.when(name.contains(t), F.lit(i)).otherwise(F.lit(len(MAJOR_DIMENSION_TOKENS)))
        for i, t in enumerate(MAJOR_DIMENSION_TOKENS)
    ])
    return dimensions.where(token < len(MAJOR_DIMENSION_TOKENS))


def reconciliation_rules(kpis: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Total, month and dimension rules of every KPI.

    ``kpis`` has ``table_name, kpi_name, date_column``; ``dimensions`` has ``table_name, dimension, position``.
    """
    alias = snake_words(F.col("kpi_name"))

    def rules(df: DataFrame, suffix: Column, grain: str, dimension: Column) -> DataFrame:
        return df.select(
            "table_name", F.col("kpi_name").alias("metric_name"),
            F.concat(F.lit("reconcile_"), alias, suffix).alias("rule_name"),
            F.lit(grain).alias("date_grain"), dimension.cast("string").alias("dimension"),
            F.lit(COMPARISON_TYPE).alias("comparison_type"), F.lit(TOLERANCE_TEXT).alias("tolerance"),
        )

    dated = kpis.where(F.coalesce("date_column", F.lit("")) != "")
    sliced = kpis.join(major_dimensions(dimensions).select("table_name", "dimension"), "table_name")
    return reduce(DataFrame.unionByName, [
        rules(kpis, F.lit(""), "overall", F.lit(None)),
        rules(dated, F.lit("_by_month"), "month", F.col("date_column")),
        rules(sliced, F.concat(F.lit("_by_"), snake_words(F.col("dimension"))), "overall", F.col("dimension")),
    ])


def rules_by_metric(rules: DataFrame) -> DataFrame:
    """Checks per metric."""
    total, month = F.col("dimension").isNull(), F.col("date_grain") == "month"
    return rules.groupBy("table_name", "metric_name").agg(
        F.count("*").alias("total_checks"), F.bool_or(total).alias("has_total_check"),
        F.count_if(month).alias("date_check_count"), F.count_if(~total & ~month).alias("dimension_check_count"),
        F.min("tolerance").alias("tolerance"),
    )


def breakdown(df: DataFrame, dimension: str, measures: Sequence[str]) -> DataFrame:
    """Rows and totals (missing values as 0) per dimension value."""
    return df.groupBy(F.col(f"`{dimension}`").alias("dimension_value")).agg(
        F.count("*").alias("row_count"), *[sum_known(F.col(f"`{m}`")).alias(m) for m in measures]
    )


def expected_totals(totals: DataFrame, expectations: DataFrame) -> DataFrame:
    """Totals against known expectations; metrics without one stay pending.

    ``totals`` has ``metric_name, metric_total``; ``expectations`` has ``metric_name, expected_total``.
    """
    known = expectations.groupBy("metric_name").agg(F.max("expected_total").alias("expected_total"))
    difference = F.col("metric_total") - F.col("expected_total")
    status = (
        F.when(F.col("expected_total").isNull(), "pending")
        .when(F.abs(difference) < EXPECTED_TOTAL_TOLERANCE, "passed").otherwise("failed")
    )
    return totals.join(known, "metric_name", "left").select(
        "metric_name", "metric_total", "expected_total", difference.alias("difference"), status.alias("status")
    )
