"""Writing tables: typed files, STORE, tables and typed or raw loads.

Loads may be repeated. A batch is a partition; writing it again replaces it and leaves the other batches alone, so a job
that failed half-way, or ran twice, is simply run again.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryload.fixed_values import AUDIT_COLUMNS
from ferryload.functions.numbers import spark_type, typed


BATCH = "_batch_id"
_REPLACE = ("partitionOverwriteMode", "dynamic")


def write_typed(df: DataFrame, folder: str, table: str, by_batch: bool = True) -> str:
    """One folder per target table, one sub-folder per batch; a batch that is there already is replaced.

    Files keep the size Spark gives them; nothing is squeezed into a single file. Without ``by_batch`` rows have no batch to
    be told by, and are appended.
    """
    path = os.path.join(folder, table.strip().replace("/", "_").replace("\\", "_") or "unnamed_table")
    if by_batch:
        df.write.mode("overwrite").option(*_REPLACE).partitionBy(BATCH).parquet(path)
    else:
        df.write.mode("append").parquet(path)
    return path


def store(df: DataFrame, path: str) -> None:
    """``STORE … INTO path``; the extension chooses the format."""
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    if extension in ("csv", "txt"):
        df.write.mode("overwrite").option("header", True).csv(path)
    elif extension in ("qvd", "parquet", ""):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"STORE does not write '{extension}' files.")


def create_table(spark: SparkSession, table: str, mapping: Sequence[dict]) -> DataFrame:
    """Empty table with the mapped columns and the audit columns, one partition per batch."""
    columns = {str(m["target_column"]).strip(): spark_type(m["target_type"]) for m in mapping}
    columns |= {name: spark_type(kind) for name, kind in AUDIT_COLUMNS.items()}
    lines = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in columns.items())
    key, value = _REPLACE
    return spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({lines}) USING parquet OPTIONS ({key} '{value}') PARTITIONED BY ({BATCH})")


def _replaces_batches(spark: SparkSession, table: str) -> bool:
    """Whether an overwrite of the table replaces only the batches that are written."""
    described = {r["col_name"]: r["data_type"] or "" for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return "=".join(_REPLACE) in described.get("Storage Properties", "")


def load_batches(rows: DataFrame, table: str) -> None:
    """Load rows by batch: a batch of the table is replaced by the batch of that id in ``rows``; others stay.

    A table that cannot replace single batches (made elsewhere, without partitions) gets only the batches that it does not
    hold yet, so that nothing is doubled there either.
    """
    spark = rows.sparkSession
    target = spark.table(table)
    if _replaces_batches(spark, table):
        rows.select(*target.columns).write.mode("overwrite").insertInto(table)
    else:
        new = rows.join(target.select(BATCH).distinct(), BATCH, "left_anti")
        new.select(*target.columns).write.insertInto(table)


def typed_rows(files: DataFrame, mapping: Sequence[dict], batch_id: str | None = None) -> DataFrame:
    """Cast every mapped column; audit columns are cast or filled.

    ``files`` must come straight from ``spark.read`` when file columns have to be filled.
    """
    present = {c.lower() for c in files.columns}
    selected = [
        typed(F.col(f"`{m['target_column']}`"), m["target_type"]).alias(m["target_column"]) for m in mapping
    ]
    filled = {
        "_source_file_name": lambda: F.col("_metadata.file_name"),
        "_source_file_path": lambda: F.col("_metadata.file_path"),
        "_ingestion_timestamp": F.current_timestamp,
        "_batch_id": lambda: F.lit(batch_id).cast("string"),
        "_record_hash": lambda: F.lit(None).cast("string"),
    }
    for name, kind in AUDIT_COLUMNS.items():
        value = typed(F.col(name), kind) if name in present else filled[name]()
        selected.append(value.alias(name))
    return files.select(*selected)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Files of :func:`write_typed`. The batch id is in the folder names; it stays the text it was, ``007`` too."""
    inferred = spark.read.parquet(path).schema
    as_text = [T.StructField(f.name, T.StringType()) if f.name.lower() == "_batch_id" else f for f in inferred.fields]
    return spark.read.schema(T.StructType(as_text)).parquet(path)


def typed_load(spark: SparkSession, path: str, table: str, mapping: Sequence[dict]) -> None:
    """INSERT … SELECT CAST … from a Parquet path; a projection only, no shuffle. It may be repeated."""
    load_batches(typed_rows(read_written(spark, path), mapping), table)


def raw_load(df: DataFrame, table: str) -> None:
    """Load without casts. With a batch column the load may be repeated; rows without one are appended."""
    spark = df.sparkSession
    if BATCH not in df.columns:
        df.write.mode("append").saveAsTable(table)
    elif spark.catalog.tableExists(table):
        load_batches(df, table)
    else:
        df.write.option(*_REPLACE).partitionBy(BATCH).saveAsTable(table)
