"""Mapping-driven typed conversion.

A mapping is a short list of rows (one per source column) that a person approved,
so it is driver-side metadata; the data itself is one projection over the source,
without any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    EMPTY_TARGET_COLUMN,
    EMPTY_TARGET_TABLE,
    NO_MAPPING_ROWS,
    REVIEW_STATUSES,
    TARGET_TYPES,
)
from ferryload.functions.classes import date_storage, field_category, review_status, target_type
from ferryload.functions.numbers import KNOWN_RULES, convert, spark_type
from ferryload.functions.text import column_name


def suggest_mapping(fields: DataFrame) -> DataFrame:
    """One mapping row per catalogue field.

    ``fields`` has ``file_name, table_name, position, field_name, tags, number_type,
    number_decimals, no_of_symbols``. Equal names within a table get ``_1, _2 …`` in
    field order; numbering is per (table, name), so no task sees a whole catalogue.
    """
    category = field_category(F.col("field_name"), F.col("tags"), F.col("number_type"))
    chosen = target_type(F.col("inferred_category"), F.col("field_name"), F.col("no_of_symbols"), F.col("number_decimals"))
    same_name = Window.partitionBy("file_name", "table_name", "__base").orderBy("position")
    repeat = F.row_number().over(same_name) - 1
    return (
        fields.withColumn("inferred_category", category)
        .withColumn("__base", column_name(F.col("field_name")))
        .withColumn("__choice", chosen)
        .withColumn("__repeat", repeat)
        .select(
            "file_name", F.col("table_name").alias("source_table"), "position",
            F.col("field_name").alias("source_column"), "inferred_category",
            column_name(F.col("table_name"), "_table").alias("target_table"),
            F.when(F.col("__repeat") == 0, F.col("__base"))
            .otherwise(F.concat_ws("_", "__base", F.col("__repeat").cast("string"))).alias("target_column"),
            "__choice.target_type", "__choice.conversion_rule", "__choice.confidence", "__choice.reason",
            review_status(F.col("__choice.confidence")).alias("review_status"),
        )
    )


def mapping_summary(mapping: DataFrame) -> DataFrame:
    """Columns, approvals, open reviews and target tables of a suggestion."""
    return mapping.agg(
        F.count("*").alias("total_columns"),
        F.count_if(F.col("review_status") == "AUTO_APPROVED").alias("auto_approved_count"),
        F.count_if(F.col("review_status") == "NEEDS_REVIEW").alias("needs_review_count"),
        F.count_distinct("target_table").alias("target_tables"),
    )


def mapping_errors(mapping: DataFrame) -> DataFrame:
    """T4: one row per broken rule: empty names, unsupported types, open reviews, repeated targets."""
    clean = mapping.select(
        *[c for c in mapping.columns if c not in ("target_table", "target_column", "target_type", "review_status")],
        *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("target_table", "target_column")],
        *[F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in ("target_type", "review_status")],
    )
    known_type, known_status = F.col("target_type").isin(TARGET_TYPES), F.col("review_status").isin(REVIEW_STATUSES)
    rules = [
        (F.col("target_table") == "", "target_table", EMPTY_TARGET_TABLE),
        (F.col("target_column") == "", "target_column", EMPTY_TARGET_COLUMN),
        (~known_type, "target_type", "Unsupported target_type."),
        (~known_status, "review_status", "Unsupported review_status."),
        (F.col("review_status") == "NEEDS_REVIEW", "review_status", "Row must be approved before saving."),
    ]
    found = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(text).alias("error")))
        for broken, field, text in rules
    ]))
    per_row = clean.select("target_table", "target_column", F.explode(found).alias("e")).select(
        "target_table", "target_column", "e.field", "e.error"
    )
    named = clean.where((F.col("target_table") != "") & (F.col("target_column") != ""))
    repeated = (
        named.groupBy(F.lower("target_table").alias("target_table"), F.lower("target_column").alias("target_column"))
        .agg(F.count("*").alias("n")).where("n > 1")
        .select("target_table", "target_column", F.lit("target_column").alias("field"),
                F.lit("Duplicate target column.").alias("error"))
    )
    empty = clean.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("").alias("target_table"), F.lit("").alias("target_column"), F.lit("mapping_rows").alias("field"),
        F.lit(NO_MAPPING_ROWS).alias("error"),
    )
    return per_row.unionByName(repeated).unionByName(empty)


def date_storage_registry(fields: DataFrame, shifted: DataFrame) -> DataFrame:
    """Storage class per date field and whether tables disagree about it.

    ``fields`` has ``table_name, field_name``; ``shifted`` lists ``field_name`` values used
    in month arithmetic, optionally per ``table_name``.
    """
    keys = [c for c in ("table_name", "field_name") if c in shifted.columns]
    marked = fields.join(
        shifted.select(*[F.lower(c).alias(f"__s_{c}") for c in keys]).distinct(),
        [F.lower(c) == F.col(f"__s_{c}") for c in keys], "left",
    )
    storage = date_storage(F.col("field_name"), F.col("__s_field_name").isNotNull())
    classed = marked.select("table_name", F.lower("field_name").alias("field_name"), storage.alias("storage_type"))
    return classed.groupBy("field_name").agg(
        F.min("storage_type").alias("storage_type"),
        F.count("*").alias("uses"),
        F.count_if(F.col("storage_type") == "unknown").alias("ambiguous_uses"),
        (F.min("storage_type") != F.max("storage_type")).alias("is_inconsistent"),
    )


def record_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the name-sorted JSON of a row; NULLs are kept, column order does not matter."""
    ordered = [F.col(f"`{c}`") for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def spelled(names: Sequence[str]) -> dict[str, str]:
    """Names by what they are without case; of names that differ in case only, the first counts."""
    return {name.lower(): name for name in reversed(names)}


def source_name_of(row: dict, source: DataFrame) -> str:
    """The source column of a mapping row as the table spells it; '' if the table has none of that name in any case."""
    name = str(row.get("source_column") or "").strip()
    return name if name in source.columns else spelled(source.columns).get(name.lower(), "")


def mapped_columns(source: DataFrame, mapping: Sequence[dict]) -> tuple[list[Column], list[str]]:
    """Converted columns in mapping order and the warnings to report.

    Source columns are found without case; a column spelled exactly like the mapping goes first. One that does not exist
    becomes a NULL column of the target type.
    """
    columns, warnings = [], []
    for row in mapping:
        source_name, found = str(row.get("source_column") or "").strip(), source_name_of(row, source)
        target_name = str(row.get("target_column") or "").strip()
        kind, rule = row.get("target_type"), str(row.get("conversion_rule") or "").strip()
        if not source_name or not target_name:
            warnings.append(f"Skipped a mapping row without source or target column: {row}")
        elif not found:
            warnings.append(f"Source column '{source_name}' not found; '{target_name}' is NULL.")
            columns.append(F.lit(None).cast(spark_type(kind)).alias(target_name))
        else:
            if rule not in KNOWN_RULES:
                warnings.append(f"Unknown conversion rule '{rule}'; '{target_name}' stays text.")
            columns.append(convert(F.col(f"`{found}`"), rule, kind).alias(target_name))
    return columns, warnings


def audit_columns(
    data_columns: Sequence[str], batch_id: str, ingested_at: str, file_name: Column, file_path: Column
) -> list[Column]:
    """File name, file path, ingestion time, batch and record hash."""
    return [
        file_name.alias("_source_file_name"), file_path.alias("_source_file_path"),
        F.lit(ingested_at).cast("timestamp").alias("_ingestion_timestamp"),
        F.lit(batch_id).alias("_batch_id"), record_hash(data_columns).alias("_record_hash"),
    ]


def convert_table(
    source: DataFrame, mapping: Sequence[dict], batch_id: str, ingested_at: str,
    observation: Observation | None = None,
) -> tuple[DataFrame, list[str]]:
    """Typed columns plus audit columns, and the warnings.

    With an ``observation`` the write that follows also reports rows and, per column,
    cells that had a value but could not be read. ``source`` must come from files.
    """
    targets = {str(m.get("target_table") or "").strip() for m in mapping} - {""}
    if len(targets) != 1:
        raise ValueError("A conversion writes exactly one target table.")
    columns, warnings = mapped_columns(source, mapping)
    named = [m for m in mapping if m.get("source_column") and m.get("target_column")]
    raw = [
        F.col(f"`{source_name_of(m, source)}`").isNotNull().alias(f"__had_{str(m['target_column']).strip()}")
        for m in named if source_name_of(m, source)
    ]
    data = [str(m["target_column"]).strip() for m in named]
    typed = source.select(
        *columns, *raw, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_path").alias("__path")
    )
    if observation is not None:
        unread = [
            F.count_if(F.col(f"`__had_{c}`") & F.col(f"`{c}`").isNull()).alias(c)
            for c in data if f"__had_{c}" in typed.columns
        ]
        typed = typed.observe(observation, F.count("*").alias("row_count"), *unread)
    audit = audit_columns(data, batch_id, ingested_at, F.col("__file"), F.col("__path"))
    return typed.select(*[F.col(f"`{c}`") for c in data], *audit), warnings


def normalised(df: DataFrame) -> DataFrame:
    """The same table with normalised, unique column names."""
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, field_name string")
    window = Window.partitionBy("base").orderBy("position")
    rows = (
        names.withColumn("base", column_name(F.col("field_name")))
        .withColumn("n", F.row_number().over(window) - 1)
        .select("position", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("name"))
        .collect()
    )
    return df.toDF(*[row["name"] for row in sorted(rows, key=lambda row: row["position"])])
