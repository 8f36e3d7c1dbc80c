"""Column profiles over whole tables.

Counts, bounds and type evidence are states that merge: one pass with a row per task and table in the shuffle, each state
kept in the column's own type (a number is compared as a number, and only text is read with patterns). Exact distinct
counts and samples need the values themselves; they are made for the columns that ask, by (column, value) in the values'
own types, so neither a frequent value nor a wide table makes a hot task. Where an estimate will do, a sketch merges, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryload.fixed_values import (
    BOOLEAN_LIKE_WORDS,
    NO_APPROVED_TYPE,
    SERIAL_DATE_HIGH,
    SERIAL_DATE_LOW,
    TYPE_FIT,
)
from ferryload.functions.numbers import reads_as_number, reads_as_whole_number

SAMPLES = 5
COLUMNS_PER_PASS = 32  # columns of one aggregation, so that its code stays compilable; each pass reads its own columns only
TEXT_FREE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _value(df: DataFrame, column: str) -> Column:
    """The column in its own type where that can be compared and grouped, else as text."""
    value = F.col(f"`{column}`")
    return value if isinstance(df.schema[column].dataType, TEXT_FREE) else value.cast("string")


def _known(df: DataFrame, column: str) -> Column:
    """NULL and blank text count as missing."""
    value = _value(df, column)
    return value.isNotNull() if isinstance(df.schema[column].dataType, TEXT_FREE) else F.coalesce(F.trim(value) != "", F.lit(False))


def _sketch(df: DataFrame, column: str) -> Column:
    """Estimate of the distinct known values, from a sketch of fixed size."""
    kind, value = df.schema[column].dataType, _value(df, column)
    comparable = value.cast("bigint") if isinstance(kind, (T.IntegralType, T.BooleanType)) else value.cast("string")
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(_known(df, column), comparable), 14))


def _facts_of(df: DataFrame, column: str) -> Column:
    """The states of one column as a struct. What a type already tells (a date is no number, a whole number has no fraction)
    is no state."""
    kind, value, rows, none = df.schema[column].dataType, _value(df, column), F.count(F.lit(1)), F.lit(0)
    low, high = F.lit(SERIAL_DATE_LOW), F.lit(SERIAL_DATE_HIGH)
    if isinstance(kind, TEXT_FREE):
        known = F.count(value)
        least, most = F.min(value).cast("string"), F.max(value).cast("string")
        word, whole, number, serial = (known, none, none, none) if isinstance(kind, T.BooleanType) else (none, none, none, none)
        if isinstance(kind, T.NumericType):
            finite = None
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                finite = F.abs(value) < float("inf")  # NaN is greater
                # other values count only where there is no number
                least, most = (F.coalesce(f(F.when(finite, value)), f(value)).cast("string") for f in (F.min, F.max))
            number = known if finite is None else F.count_if(finite)
            is_whole = value == F.floor(value)
            whole = known if isinstance(kind, T.IntegralType) else F.count_if(is_whole if finite is None else finite & is_whole)
            serial = F.count_if(value.between(low, high))
            if isinstance(kind, T.IntegralType) or getattr(kind, "scale", 1) == 0:
                word = F.count_if(value.isin(0, 1))
    else:
        trimmed, is_number = F.trim(value), reads_as_number(value)
        double = F.when(is_number, trimmed.try_cast("double"))
        by_number = F.when(is_number, F.struct(double.alias("number"), trimmed.try_cast("decimal(38,6)").alias("exact"), trimmed.alias("text")))
        text = F.when(trimmed != "", value)
        known, word, number = F.count(text), F.count_if(F.lower(trimmed).isin(BOOLEAN_LIKE_WORDS)), F.count_if(is_number)
        whole, serial = F.count_if(is_number & reads_as_whole_number(value)), F.count_if(double.between(low, high))
        # numbers are compared as numbers; if there are none, texts as texts
        least, most = (F.coalesce(f(by_number)["text"], f(text)) for f in (F.min, F.max))
    return F.struct(
        F.lit(column).alias("column_name"), rows.alias("row_count_checked"), (rows - known).alias("null_count"), known.alias("non_null_count"),
        F.coalesce(least, F.lit("")).alias("min_value"), F.coalesce(most, F.lit("")).alias("max_value"),
        *[n.cast("bigint").alias(name) for name, n in (("boolean_rows", word), ("whole_rows", whole), ("number_rows", number), ("serial_rows", serial))],
    )


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, exact: Sequence[str] = ()) -> DataFrame:
    """Counts, bounds and type evidence, one row per column; ``distinct_count`` for the columns named in ``exact``, else NULL.

    The states of all columns of a pass are one array, so every reader of the result shares one aggregation.
    """
    names = list(columns or df.columns)
    passes = [names[i : i + COLUMNS_PER_PASS] for i in range(0, len(names), COLUMNS_PER_PASS)]
    facts = reduce(DataFrame.unionByName, [
        df.agg(F.array(*[_facts_of(df, c) for c in some]).alias("__facts")).select(F.inline("__facts")) for some in passes
    ])
    if not exact:
        return facts.withColumn("distinct_count", F.lit(None).cast("bigint"))
    counted = distinct_values(df, exact).groupBy("column_name").agg(F.count("*").alias("__distinct"))
    asked = F.when(F.col("column_name").isin(list(exact)), F.coalesce("__distinct", F.lit(0)))
    return facts.join(counted, "column_name", "left").withColumn("distinct_count", asked).drop("__distinct")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Known distinct values as ``(column_name, text)``; columns of one type are told apart from each other in one shuffle."""
    by_type: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        by_type.setdefault(kind.simpleString() if isinstance(kind, TEXT_FREE) else "string", []).append(c)
    parts = []
    for some in by_type.values():
        values = df.select(*[F.when(_known(df, c), _value(df, c)).alias(c) for c in some])
        pairs = values.unpivot([], [F.col(f"`{c}`") for c in some], "column_name", "value").where("value IS NOT NULL")
        parts.append(pairs.distinct().select("column_name", F.col("value").cast("string").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def runtime_type(approved: Column) -> Column:
    """Q2: type of the values, from :func:`column_facts`; serial dates need an approved DATE."""
    known = F.col("non_null_count")
    return (
        F.when(known == 0, "STRING")
        .when((F.upper(approved) == "DATE") & (F.col("serial_rows") == known), "QLIK_DATE_SERIAL")
        .when(F.col("boolean_rows") == known, "BOOLEAN_LIKE")
        .when(F.col("whole_rows") == known, "INTEGER")
        .when(F.col("number_rows") == known, "DECIMAL")
        .otherwise("STRING")
    )


def match_status(detected: Column, approved: Column) -> tuple[Column, Column]:
    """Q3: status and reason of detected against approved type."""
    status = F.when(approved == "", F.lit("NEEDS_REVIEW"))
    reason = F.when(approved == "", F.lit(NO_APPROVED_TYPE))
    for kind, (fitting, verdict, text) in TYPE_FIT.items():
        fits = approved.isin(fitting)
        status = status.when(detected == kind, F.when(fits, F.lit("MATCH")).otherwise(F.lit(verdict)))
        reason = reason.when(detected == kind, F.when(fits, F.lit("")).otherwise(F.lit(text)))
    return status, reason


def samples(values: DataFrame) -> DataFrame:
    """Up to five smallest texts per column of :func:`distinct_values`; each task passes on only its own five."""
    smallest = Window.partitionBy("column_name").orderBy("text")
    ranked = values.withColumn("__r", F.row_number().over(smallest))
    return ranked.where(F.col("__r") <= SAMPLES).groupBy("column_name").agg(F.array_sort(F.collect_list("text")).alias("sample_values"))


def profile(
    df: DataFrame, approved: DataFrame | None = None, columns: Sequence[str] | None = None, exact: Sequence[str] | None = None
) -> DataFrame:
    """Q1-Q3: one row per column over all rows of the table.

    ``approved`` has ``source_column, target_type``; names are compared without case. Distinct counts and samples are made
    for the columns in ``exact`` (all of them, if not given); others have neither, but are profiled without a shuffle of values.
    """
    names = list(columns or df.columns)
    asked = names if exact is None else [c for c in names if c in set(exact)]
    facts = column_facts(df, names, asked)
    if asked:
        facts = facts.join(samples(distinct_values(df, asked)), "column_name", "left")
    else:
        facts = facts.withColumn("sample_values", F.lit(None).cast("array<string>"))
    if approved is None:
        facts = facts.withColumn("approved_target_type", F.lit(""))
    else:
        wanted = approved.select(
            F.lower(F.trim("source_column")).alias("__c"), F.upper(F.trim("target_type")).alias("__t")
        ).groupBy("__c").agg(F.max("__t").alias("__t"))
        facts = facts.join(wanted, F.lower("column_name") == F.col("__c"), "left").withColumn(
            "approved_target_type", F.coalesce("__t", F.lit(""))
        )
    detected = facts.withColumn("detected_runtime_type", runtime_type(F.col("approved_target_type")))
    status, reason = match_status(F.col("detected_runtime_type"), F.col("approved_target_type"))
    return detected.select(
        "column_name", "row_count_checked", "null_count", "non_null_count", "distinct_count",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "min_value", "max_value", "detected_runtime_type", "approved_target_type",
        status.alias("type_match_status"), reason.alias("warning_reason"),
    )


def quick_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts and estimated distinct counts in one pass with fixed-size state per column."""
    names = list(columns or df.columns)
    states = [
        F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count_checked"), F.count_if(_known(df, c)).alias("non_null_count"),
                 F.coalesce(_sketch(df, c), F.lit(0)).alias("approx_distinct_count")) for c in names
    ]
    passes = [states[i : i + COLUMNS_PER_PASS] for i in range(0, len(names), COLUMNS_PER_PASS)]
    return reduce(DataFrame.unionByName, [df.agg(F.array(*some).alias("__facts")).select(F.inline("__facts")) for some in passes])


def profile_summary(profiled: DataFrame) -> DataFrame:
    """Q4: columns and verdicts of a profile."""
    status = F.col("type_match_status")
    return profiled.agg(
        F.count("*").alias("total_columns"), F.max("row_count_checked").alias("rows_checked"),
        F.count_if(status == "MATCH").alias("match_count"),
        F.count_if(status == "NEEDS_REVIEW").alias("needs_review_count"),
        F.count_if(status == "MISMATCH").alias("mismatch_count"),
    )
