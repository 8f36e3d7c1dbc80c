"""Reading tables: files, earlier tables, inline text, SQL text, views."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """All rows of a file or folder, lazily. Text formats should come with a schema."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load(
    source: DataFrame,
    fields: Sequence[Column | str] = (),
    where: Sequence[Column] = (),
    group: Sequence[Column | str] = (),
    aggregates: Sequence[Column] = (),
    order: Sequence[Column | str] = (),
    distinct: bool = False,
) -> DataFrame:
    """One LOAD over a file table or an earlier (RESIDENT) table.

    Conditions are joined with AND before the projection, so they reach the scan.
    """
    rows = source
    for condition in where:
        rows = rows.where(condition)
    if group or aggregates:
        rows = rows.groupBy(*group).agg(*aggregates)
    if fields:
        rows = rows.select(*fields)
    if distinct:
        rows = rows.distinct()
    return rows.orderBy(*order) if order else rows


def inline_table(spark: SparkSession, text: str) -> DataFrame:
    """S3: INLINE load. First line is the header; short rows are filled with empty text.

    The text is part of the caller's program, so its size is bounded by it; no row is cut off.
    """
    lines = [line.strip() for line in re.split(r"\r\n|\r|\n", text)]
    lines = [line for line in lines if line and not line.startswith("//")]
    cells = [row for row in csv.reader(io.StringIO("\n".join(lines)), skipinitialspace=True) if row]
    if not cells:
        raise ValueError("An inline table needs a header line.")
    header = [name.strip().strip("\"'") for name in cells[0]]
    kept = [i for i, name in enumerate(header) if name]
    rows = [[row[i].strip() if i < len(row) else "" for i in kept] for row in cells[1:]]
    schema = T.StructType([T.StructField(header[i], T.StringType()) for i in kept])
    return spark.createDataFrame(rows, schema)


def inline_column(df: DataFrame, column: str, schema: str, **options) -> DataFrame:
    """S3: CSV lines that arrive as data, one line per row, read with a schema."""
    return df.select(F.from_csv(F.col(column), schema, {"ignoreLeadingWhiteSpace": "true", **options}).alias("r")).select("r.*")


def sql_source(spark: SparkSession, text: str, parameters: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Pass-through SELECT; ``{name}`` refers to a given DataFrame, ``:name`` to a parameter."""
    return spark.sql(text, args=parameters, **tables)


def view(df: DataFrame, name: str) -> DataFrame:
    """Temporary view over a table."""
    df.createOrReplaceTempView(name)
    return df


def file_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Temporary view over a Parquet path."""
    return view(read_table(spark, path), name)


def drop_table(tables: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """The model without the named tables (names compared without case)."""
    gone = {name.strip().strip("[]").lower() for name in names}
    return {name: df for name, df in tables.items() if name.lower() not in gone}


def part_files(df: DataFrame) -> DataFrame:
    """The part files behind a file table, with their sizes, as rows. Only the file list is read, no row of the table."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return spark.createDataFrame([], "file_path string, file_size bigint")
    listed = spark.read.format("binaryFile").load(files)
    return listed.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
