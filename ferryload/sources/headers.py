"""Extract headers: one catalogue row per field of every file in a folder.

An extract starts with an XML header followed by binary pages. Only the header is
read as text; the pages are never decoded.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    HEADER_END,
    HEADER_FIELD_TAG,
    HEADER_ROW_TAG,
    HEADER_START,
)
from ferryload.functions.classes import field_category

NUMBER_FORMAT = "struct<Type:string,nDec:string,UseThou:string,Fmt:string,Dec:string,Thou:string>"
HEADER_SCHEMA = (
    "TableName string, NoOfRecords string, CreatorDoc string, CreateUtcTime string,"
    " SourceCreateUtcTime string, Fields struct<" + HEADER_FIELD_TAG + ":array<struct<"
    "FieldName:string, BitOffset:string, BitWidth:string, Bias:string, NumberFormat:" + NUMBER_FORMAT + ","
    " NoOfSymbols:string, Offset:string, Length:string, Tags:struct<String:array<string>>>>>"
)


def read_extract_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as ``(path, length, content)``; files are spread over tasks."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_extract_heads(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_extract_files`, but a file is read only up to the end of its header.

    Files are listed by Spark and opened inside the tasks through Arrow's file systems, so
    extracts far larger than a task's memory are fine. A header starts within the first ``SCAN_BYTES`` and ends
    within them; a file without one is read that far, holds nothing of what was read, and is listed with NULL content.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def read_heads(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"path": [row.path], "length": [row.length], "content": pd.Series([_read_head(row.path)], dtype=object)})

    return listed.mapInPandas(read_heads, "path string, length bigint, content binary")


SCAN_BYTES = 16 * 1024 * 1024
_CHUNK_BYTES = 64 * 1024


def _read_head(path: str) -> bytes | None:
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":  # Spark lists local files as file:/folder/name, blanks and all
        system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest, safe="/:@"))
    with system.open_input_stream(name) as stream:
        return _head_of(stream)


def _head_of(stream) -> bytes | None:
    """Bytes from the start mark to the end mark. Before the start mark only its possible beginning is held."""
    first, last = HEADER_START.encode(), HEADER_END.encode()
    held, begun, seen = bytearray(), False, 0
    while seen < SCAN_BYTES:
        chunk = stream.read(min(_CHUNK_BYTES, SCAN_BYTES - seen))
        if not chunk:
            break
        seen += len(chunk)
        searched = max(0, len(held) - len(last))
        held.extend(chunk)
        if not begun:
            at = held.find(first)
            begun = at >= 0
            del held[: at if begun else max(0, len(held) - len(first))]
            searched = 0
        if begun:
            end = held.find(last, searched)
            if end >= 0:
                return bytes(held[: end + len(last)])
    return None


def cut_headers(files: DataFrame) -> DataFrame:
    """Header text of each file; files without a complete header get NULL.

    Bytes are first read one to one (Latin-1) to find the markers, then the cut is read
    as UTF-8, so binary pages behind the header cannot spoil the text.
    """
    raw = F.decode(F.col("content"), "ISO-8859-1")
    end = F.instr(raw, HEADER_END)
    start = F.instr(raw, HEADER_START)
    whole = (start > 0) & (end > start)
    cut = F.substring(raw, start, end - start + len(HEADER_END))
    header = F.when(whole, F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"))
    return files.select("path", "length", header.alias("header"))


def header_tables(files: DataFrame) -> DataFrame:
    """One row per file with its fields as an array."""
    parsed = cut_headers(files).withColumn(
        "h", F.from_xml("header", HEADER_SCHEMA, {"rowTag": HEADER_ROW_TAG, "mode": "PERMISSIVE"})
    )
    file_name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    text = lambda name: F.trim(F.coalesce(F.col(f"h.{name}"), F.lit("")))
    fields = F.coalesce(F.col(f"h.Fields.{HEADER_FIELD_TAG}"), F.array())
    return parsed.select(
        file_name.alias("file_name"), F.col("path").alias("file_path"),
        F.col("length").alias("file_size_bytes"),
        F.when(text("TableName") == "", stem).otherwise(text("TableName")).alias("table_name"),
        text("NoOfRecords").alias("no_of_records"), text("CreatorDoc").alias("creator_doc"),
        text("CreateUtcTime").alias("create_utc_time"),
        text("SourceCreateUtcTime").alias("source_create_utc_time"),
        F.size(fields).alias("field_count"), F.col("header").isNotNull().alias("has_header"),
        fields.alias("fields"),
    )


def header_fields(files: DataFrame) -> DataFrame:
    """One row per field of every file."""
    tables = header_tables(files)
    field = lambda name: F.trim(F.coalesce(F.col(f"f.{name}"), F.lit("")))
    return tables.select(
        "file_name", "table_name", "no_of_records", F.posexplode("fields").alias("position", "f")
    ).select(
        "file_name", "table_name", "no_of_records", (F.col("position") + 1).alias("position"),
        field("FieldName").alias("field_name"),
        F.filter(
            F.transform(F.coalesce(F.col("f.Tags.String"), F.array()), F.trim), lambda t: t != ""
        ).alias("tags"),
        F.upper(field("NumberFormat.Type")).alias("number_type"),
        field("NumberFormat.nDec").alias("number_decimals"),
        F.to_json("f.NumberFormat").alias("number_format"),
        field("BitOffset").alias("bit_offset"), field("BitWidth").alias("bit_width"),
        field("Bias").alias("bias"), field("NoOfSymbols").alias("no_of_symbols"),
        field("Offset").alias("offset"), field("Length").alias("length"),
    )


def source_structure(files: DataFrame) -> DataFrame:
    """The field listing with the inferred class of each field."""
    fields = header_fields(files)
    category = field_category(F.col("field_name"), F.col("tags"), F.col("number_type"))
    return fields.select(
        "file_name", "table_name", "no_of_records", F.col("position").alias("field_position"),
        "field_name", F.array_join("tags", "|").alias("tags"), "number_format", "number_type",
        "number_decimals", "no_of_symbols", "bit_offset", "bit_width", category.alias("inferred_category"),
    )
