"""Queries for loads, projections, unions, sorting and top rows (S*, P*, O*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload.functions import conditions as C
from ferryload.functions import dates as D
from ferryload.functions import text as X
from ferryload.fixed_values import COUNT_TOKENS, DATE_TOKENS, DECIMAL_TOKENS, FLAG_TOKENS, KEY_TOKENS, RESERVED_WORDS
from ferryload.operators import catalog, checks, combine, conversion, joins, ordering
from ferryload.plans.tables import Tables, day, exact_mean
from ferryload.session import JobFolder
from ferryload.sources import headers, sinks, tables as S

PRIORITY_MAP = """
priority, label
1-URGENT, rush
2-HIGH, rush
3-MEDIUM, normal
3-MEDIUM, second entry is ignored
4-NOT SPECIFIED
"""


def load_project_filter(t: Tables):
    return S.load(
        t.lineitem,
        fields=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net_price"),
                day("l_shipdate").alias("ship_date")],
        where=[F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"), F.col("l_quantity") > 30],
        order=["l_orderkey", "l_linenumber", "l_partkey"],
    )


def resident_groupby(t: Tables):
    shipped = S.load(t.lineitem, where=[F.col("l_returnflag") != "N"])
    return S.load(
        shipped, group=["l_returnflag", "l_linestatus"],
        aggregates=[
            F.count("*").alias("line_count"), F.sum("l_quantity").alias("sum_qty"),
            exact_mean("l_extendedprice").alias("avg_price"),
            F.min(day("l_shipdate")).alias("first_ship"), F.max(day("l_shipdate")).alias("last_ship"),
        ],
    )


def distinct_load(t: Tables):
    return S.load(t.orders, fields=["o_orderstatus", "o_orderpriority"], distinct=True)


def sql_pass_through(t: Tables):
    return S.sql_source(
        t.spark,
        "SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey"
        " WHERE c_acctbal >= :low GROUP BY n_name",
        {"low": 1000.0}, c=t.customer, n=t.nation,
    )


def inline_mapping_apply(t: Tables):
    rows = S.inline_table(t.spark, PRIORITY_MAP)
    label = joins.mapping(rows, "priority", "label")
    mapped = joins.apply_map(t.orders.select("o_orderkey", "o_orderpriority"), label, "o_orderpriority", "label")
    return joins.apply_map(mapped, label, "o_orderpriority", "label_or_other", F.lit("other"))


def inline_rows_from_data(t: Tables):
    lines = t.part.select(F.concat_ws(", ", "p_partkey", "p_brand", "p_name").alias("line"))
    return S.inline_column(lines, "line", "part_id bigint, brand string, name string")


def map_literal_apply(t: Tables):
    pairs = {"A": "returned", "N": "none"}
    label = joins.map_literal(F.col("l_returnflag"), pairs)
    return t.lineitem.groupBy(label.alias("flag_text")).agg(F.count("*").alias("line_count"))


def source_identity(t: Tables):
    return t.pages.select("page_id", X.source_identity(F.col("url")).alias("identity"))


def preview_rows(t: Tables):
    return ordering.preview(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 100, ["o_orderkey"])


def part_file_rows(t: Tables):
    files = S.part_files(t.lineitem)
    rows = t.lineitem.groupBy("_metadata.file_path").agg(F.count("*").alias("rows"))
    # the list spells a path file:/..., the rows' metadata file:///...
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = rows.select(plain("file_path").alias("at"), "rows").join(files.where("file_size > 0").select(plain("file_path").alias("at")), "at")
    return listed.agg((F.count("*") > 0).alias("has_files"), F.sum("rows").alias("rows"))


def full_read(t: Tables):
    """Every column and row of a file."""
    return S.read_table(t.spark, f"{t.folder}/supplier.parquet").withColumn("s_nationkey", F.col("s_nationkey").cast("bigint"))


def file_view(t: Tables):
    """A view over a path, read with SQL."""
    S.file_view(t.spark, f"{t.folder}/nation.parquet", "ferryload_nations")
    return t.spark.sql("SELECT n_regionkey % 2 = 0 AS even_region, count(*) AS nations, min(n_name) AS first_name FROM ferryload_nations GROUP BY 1")


def repeated_load(t: Tables):
    """Batches of orders are written, one of them again with other rows, and read: the last writing of a batch counts."""
    folder = JobFolder(t.spark, "repeated_load").path
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    batch = lambda status, name: orders.where(F.col("o_orderstatus") == status).withColumn("_batch_id", F.lit(name))
    sinks.write_typed(batch("F", "007").unionByName(batch("P", "b8")), folder, "orders")
    sinks.write_typed(batch("F", "007"), folder, "orders")
    path = sinks.write_typed(batch("O", "b8"), folder, "orders")
    return sinks.read_written(t.spark, path).groupBy("_batch_id").agg(
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"), F.min("o_orderstatus").alias("status"))


def page_extracts(t: Tables):
    """Extract files built by Spark from the pages: an XML header with a field per navigation link, then page bytes."""
    labels = F.regexp_extract_all("html", F.lit('<li><a href="/([^"<&]*)"'), F.lit(1))
    field = F.transform(labels, lambda name, i: F.concat(
        F.lit("<QvdFieldHeader><FieldName>"), name, F.lit("</FieldName><BitOffset>"), (i * 8).cast("string"),
        F.lit("</BitOffset><BitWidth>8</BitWidth><NumberFormat><Type>"),
        F.when(i % 2 == 1, "REAL").otherwise("UNKNOWN"), F.lit("</Type></NumberFormat><NoOfSymbols>"),
        F.length(name).cast("string"), F.lit("</NoOfSymbols><Tags><String>"),
        F.when(i % 2 == 1, "$numeric").otherwise("$text"), F.lit("</String></Tags></QvdFieldHeader>"),
    ))
    header = F.concat(
        F.lit("<QvdTableHeader><TableName>"), F.regexp_extract("url", "^https?://([^/]+)", 1),
        F.lit("</TableName><NoOfRecords>"), F.length("html").cast("string"), F.lit("</NoOfRecords><Fields>"),
        F.array_join(field, ""), F.lit("</Fields></QvdTableHeader>"),
    )
    content = F.concat(F.unhex(F.lit("0000")), F.encode(header, "UTF-8"), F.unhex(F.lit("00FFFE")), F.encode("html", "UTF-8"))
    return t.pages.select(
        F.concat(F.lit("extracts/page_"), "page_id", F.lit(".qvd")).alias("path"),
        F.length(content).cast("bigint").alias("length"), content.alias("content"),
    )


def extract_header_fields(t: Tables):
    return headers.header_fields(page_extracts(t)).select(
        "file_name", "table_name", "no_of_records", F.col("position").cast("bigint").alias("position"),
        "field_name", F.array_join("tags", "|").alias("tags"), "number_type", "bit_offset", "no_of_symbols",
    )


def extract_header_files(t: Tables):
    """One extract file per nation with its table's statistics as header and page bytes behind it, written to the job's own
    folder, read up to the end of each header."""
    folder = JobFolder(t.spark, "extract_headers").path
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_name").alias("last"))
    field = "<QvdFieldHeader><FieldName>{}</FieldName><NoOfSymbols>{}</NoOfSymbols></QvdFieldHeader>"
    header = F.format_string(
        "<QvdTableHeader><TableName>customers_%s</TableName><NoOfRecords>%s</NoOfRecords><Fields>" + field.format("CustKey", "%s")
        + field.format("Größe", "1") + "</Fields></QvdTableHeader>", F.col("c_nationkey").cast("string"), F.col("n").cast("string"), F.col("n").cast("string"))
    broken = F.when(F.col("c_nationkey") % 7 == 3, F.regexp_replace(header, "</QvdTableHeader>", "")).otherwise(header)
    text = F.concat(broken, F.lit(chr(0)), F.repeat("last", 5000))
    counts.select(F.col("c_nationkey").cast("string").alias("nation"), text.alias("value")).repartition("nation").write.partitionBy("nation").text(folder)
    files = headers.read_extract_heads(t.spark, folder)
    fields = headers.header_fields(files).select("table_name", "no_of_records", "field_name", F.col("position").cast("bigint").alias("position"), "no_of_symbols")
    none = headers.header_tables(files).where("NOT has_header").select(F.lit("without header").alias("table_name"))
    return fields.unionByName(none, allowMissingColumns=True)


def fields_by_class(t: Tables):
    rows = headers.source_structure(page_extracts(t)).select(
        F.col("file_name").alias("table_name"), F.col("field_position").alias("position"), "field_name", "inferred_category")
    return catalog.fields_by_class(rows)


def source_structure(t: Tables):
    return headers.source_structure(page_extracts(t)).groupBy("table_name", "inferred_category").agg(
        F.count("*").alias("fields"), F.count_distinct("file_name").alias("files")
    )


def schema_suggestion(t: Tables):
    return conversion.suggest_mapping(headers.header_fields(page_extracts(t))).select(
        "file_name", F.col("position").cast("bigint").alias("position"), "source_column", "inferred_category",
        "target_table", "target_column", "target_type", "conversion_rule", "confidence", "review_status",
    )


def schema_suggestion_summary(t: Tables):
    return conversion.mapping_summary(conversion.suggest_mapping(headers.header_fields(page_extracts(t))))


def mapping_errors(t: Tables):
    mapping = conversion.suggest_mapping(headers.header_fields(page_extracts(t)))
    errors = conversion.mapping_errors(mapping.drop("target_table").withColumn("target_table", F.col("source_table")))
    return errors.groupBy("field", "error").agg(F.count("*").alias("rows"))


def drop_fields_after_concat(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))
    both = combine.concatenate(orders, lines)
    dropped = combine.drop_fields(orders, "status")
    return combine.concatenate(
        both.groupBy("status").agg(F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("amount"), F.sum("quantity").alias("quantity")),
        dropped.agg(F.count("*").alias("rows"), F.lit("after drop: " + ",".join(dropped.columns)).alias("status")),
    )


def _facts(t: Tables):
    fact = t.orders.select(
        F.col("o_orderkey").alias("OrderKey"), F.col("o_custkey").alias("CustKey"),
        F.date_format("o_orderdate", "yyyyMM").alias("YYYYMM"), F.col("o_totalprice").alias("SalesAmount"),
    )
    expenses = t.lineitem.select(
        F.col("l_orderkey").alias("OrderKey"), F.date_format("l_shipdate", "yyyyMM").alias("YYYYMM"),
        F.col("l_returnflag").alias("Account"), F.col("l_tax").alias("SalesAmount"),
    )
    return fact, expenses


def concat_widen(t: Tables):
    fact, expenses = _facts(t)
    return combine.concatenate(fact, expenses)


def concat_target(t: Tables):
    fact, expenses = _facts(t)
    return combine.concatenate_into(fact, expenses, ["OrderKey", "YYYYMM", "Account"])


def plain_concat(t: Tables):
    return combine.append(
        t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    )


def no_concatenate(t: Tables):
    base = {"customers": t.customer.select(F.col("c_nationkey").alias("nationkey"))}
    model = combine.no_concatenate(base, "suppliers", t.supplier.select(F.col("s_nationkey").alias("nationkey")))
    remaining = S.drop_table(model, "CUSTOMERS")
    return checks.tagged_counts(**model).withColumn("tables_after_drop", F.lit(",".join(remaining)))


def first_per_key(t: Tables):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return ordering.keep_first(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def metric_totals(t: Tables):
    rows = combine.metric_rows(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.select("metric_name", F.round("metric_total", 2).alias("metric_total"))


def previous_value(t: Tables):
    rows = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    return ordering.previous_value(rows, "value", ["user_id"], ["ts", "event_id"], "previous_value").select(
        "event_id", "user_id", "value", "previous_value"
    )


def rowno(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey")
    return ordering.row_numbers(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "row_no").select("o_orderkey", "o_custkey", "row_no")


def recno(t: Tables):
    rows = t.events.select("ts", "event_id")
    return ordering.row_numbers(rows, [], ["ts", "event_id"], "rec_no").select("event_id", "rec_no")


def peek(t: Tables):
    rows = t.events.select("user_id", "ts", "event_id", "value")
    return ordering.peek(rows, "value", ["user_id"], ["ts", "event_id"], 3, "three_back").select("event_id", "user_id", "three_back")


def latest_per_key(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ordering.keep_latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def recent_top20(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return ordering.most_recent(rows, "o_orderdate", ["o_orderkey"]).select("o_orderkey", day("o_orderdate").alias("order_date"), "o_totalprice")


def multi_sort(t: Tables):
    rows = t.customer.select("c_mktsegment", "c_acctbal", "c_custkey")
    return ordering.sort_by(rows, [("c_mktsegment", "asc"), ("c_acctbal", "desc")], ["c_custkey"])


def stable_order(t: Tables):
    """The same columns in the same order, however a table was put together."""
    one = t.orders.select("o_totalprice", "o_orderkey", "o_custkey")
    other = t.orders.select("o_custkey", "o_orderkey").withColumn("O_Extra", F.lit(1).cast("bigint")).join(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")
    tables = combine.stable_tables({"b": one.withColumn("O_Extra", F.lit(2).cast("bigint")), "A": other})
    parts = [df.select("*", F.lit(",".join(df.columns)).alias("column_order"), F.lit(i).cast("bigint").alias("place")) for i, df in enumerate(tables.values())]
    return parts[0].union(parts[1])  # by position: both have the same order


def text_number_predicate(t: Tables):
    part = t.part.select("p_partkey", F.col("p_size").alias("Size"), F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_name")).alias("ProductName"))
    return part.select(
        "p_partkey",
        C.compare_with_number("ProductName", "=", 0).alias("name_eq_0"),
        C.compare_with_number("ProductName", ">", 0).alias("name_gt_0"),
        C.compare_with_number("ProductName", "<>", 5).alias("name_ne_5"),
        C.compare_with_number("Size", ">", 25).alias("size_gt_25"),
    )


def history_flag(t: Tables):
    month = D.month_start(F.col("o_orderdate"))
    flag = C.history_flag(month, "1998-05-31")
    return t.orders.groupBy(flag.alias("history_flag")).agg(F.count("*").alias("orders"), F.max(month).alias("last_month"))


def conditional_if(t: Tables):
    size = C.if_(F.col("l_quantity") >= 40, F.lit("large"), C.if_(F.col("l_quantity") >= 20, F.lit("medium"), F.lit("small")))
    return t.lineitem.groupBy(size.alias("size_class")).agg(F.count("*").alias("lines"))


QUERIES = {f.__name__: f for f in (
    load_project_filter, resident_groupby, distinct_load, sql_pass_through, inline_mapping_apply,
    inline_rows_from_data, map_literal_apply, source_identity, preview_rows, part_file_rows, full_read, file_view, repeated_load,
    extract_header_fields, extract_header_files, fields_by_class, source_structure, schema_suggestion, schema_suggestion_summary, mapping_errors,
    drop_fields_after_concat, concat_widen, concat_target, plain_concat, no_concatenate, first_per_key,
    metric_totals, previous_value, rowno, recno, peek, latest_per_key, recent_top20, multi_sort, stable_order,
    text_number_predicate, history_flag, conditional_if,
)}

PAGE_FIELDS = """
fields AS (
  SELECT page_id, 'page_' || page_id || '.qvd' AS file_name, regexp_extract(url, '^https?://([^/]+)', 1) AS table_name,
         CAST(length(html) AS VARCHAR) AS no_of_records, u.i AS position,
         trim(u.name) AS field_name, length(u.name) AS symbols,
         CASE WHEN u.i % 2 = 0 THEN '$numeric' ELSE '$text' END AS tags,
         CASE WHEN u.i % 2 = 0 THEN 'REAL' ELSE 'UNKNOWN' END AS number_type
  FROM pages, LATERAL (
    SELECT unnest(l) AS name, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT regexp_extract_all(html, '<li><a href="/([^"<&]*)"', 1) AS l)
  ) u
),
classed AS (
  SELECT *, CASE
    WHEN regexp_matches(lower(field_name), '""" + "|".join(DATE_TOKENS) + """') THEN 'DATE_LIKE'
    WHEN regexp_matches(lower(field_name), '""" + "|".join(KEY_TOKENS) + """') THEN 'KEY_LIKE'
    WHEN tags = '$text' THEN 'TEXT_LIKE'
    WHEN regexp_matches(lower(field_name), '""" + "|".join(FLAG_TOKENS) + """') THEN 'FLAG_LIKE'
    ELSE 'NUMERIC_LIKE' END AS inferred_category
  FROM fields
)"""


def snake_sql(name: str) -> str:
    """The name rule of P8 in DuckDB's regular expressions (no look-around there)."""
    steps = [("^%+", ""), (r"[./\\\s]+", "_"), ("[^0-9A-Za-z_]+", "_"), ("([A-Z])([A-Z][a-z])", r"\1_\2"),
             ("([a-z0-9])([A-Z])", r"\1_\2"), ("_+", "_"), ("^_+|_+$", "")]
    sql = f"trim({name})"
    for pattern, replacement in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    sql = rf"regexp_replace(lower({sql}), '^([a-z]{{1,2}})_([a-z])_', '\1\2_')"
    return f"CASE WHEN {sql} = '' THEN 'unnamed' ELSE {sql} END"


RESERVED = ", ".join(f"'{word}'" for word in sorted(RESERVED_WORDS))

SUGGESTION = PAGE_FIELDS + f""",
named AS (SELECT *, {snake_sql('field_name')} AS s, {snake_sql('table_name')} AS ts FROM classed),
digits AS (SELECT *, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'col_' || s ELSE s END AS d,
                  CASE WHEN regexp_matches(ts, '^[0-9]') THEN 'col_' || ts ELSE ts END AS td FROM named),
based AS (SELECT *, CASE WHEN d IN ({RESERVED}) THEN d || '_col' ELSE d END AS base,
                 CASE WHEN td IN ({RESERVED}) THEN td || '_table' ELSE td END AS target_table FROM digits),
suggested AS (
  SELECT file_name, table_name, position, field_name AS source_column, inferred_category, target_table,
    CASE WHEN rn = 0 THEN base ELSE base || '_' || rn END AS target_column,
    CASE inferred_category WHEN 'DATE_LIKE' THEN 'DATE' WHEN 'TEXT_LIKE' THEN 'STRING' WHEN 'KEY_LIKE' THEN 'STRING'
      WHEN 'FLAG_LIKE' THEN CASE WHEN symbols <= 2 THEN 'BOOLEAN' ELSE 'INT' END
      ELSE CASE WHEN regexp_matches(lower(field_name), '{"|".join(COUNT_TOKENS)}') THEN 'BIGINT'
                WHEN regexp_matches(lower(field_name), '{"|".join(DECIMAL_TOKENS)}') THEN 'DECIMAL(18,2)'
                ELSE 'DOUBLE' END END AS target_type
  FROM (SELECT *, row_number() OVER (PARTITION BY file_name, table_name, base ORDER BY position) - 1 AS rn FROM based)
),
mapped AS (
  SELECT *, CASE target_type WHEN 'DATE' THEN 'qlik_serial_to_date' WHEN 'STRING' THEN 'cast_string' WHEN 'BIGINT' THEN 'cast_bigint'
      WHEN 'DECIMAL(18,2)' THEN 'cast_decimal_18_2' WHEN 'DOUBLE' THEN 'cast_double' ELSE 'flag_to_boolean_or_int_review' END AS conversion_rule,
    CAST(CASE target_type WHEN 'DOUBLE' THEN 0.7 WHEN 'INT' THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence,
    CASE WHEN target_type IN ('DOUBLE', 'INT') THEN 'NEEDS_REVIEW' ELSE 'AUTO_APPROVED' END AS review_status
  FROM suggested
)"""

FACTS = """
fact AS (SELECT o_orderkey AS "OrderKey", o_custkey AS "CustKey", strftime(o_orderdate, '%Y%m') AS "YYYYMM", o_totalprice AS "SalesAmount" FROM orders),
expenses AS (SELECT l_orderkey AS "OrderKey", strftime(l_shipdate, '%Y%m') AS "YYYYMM", l_returnflag AS "Account", l_tax AS "SalesAmount" FROM lineitem)"""

ORACLE = {
    "load_project_filter": """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net_price,
             CAST(l_shipdate AS DATE) AS ship_date
      FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 30 ORDER BY 1, 2, 3""",
    "resident_groupby": """
      WITH shipped AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N')
      SELECT l_returnflag, l_linestatus, count(*) AS line_count, sum(l_quantity) AS sum_qty,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price, min(CAST(l_shipdate AS DATE)) AS first_ship, max(CAST(l_shipdate AS DATE)) AS last_ship
      FROM shipped GROUP BY ALL""",
    "distinct_load": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "sql_pass_through": """
      SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
      WHERE c_acctbal >= 1000.0 GROUP BY n_name""",
    "inline_mapping_apply": """
      WITH m(priority, label) AS (VALUES ('1-URGENT', 'rush'), ('2-HIGH', 'rush'), ('3-MEDIUM', 'normal'), ('4-NOT SPECIFIED', ''))
      SELECT o_orderkey, o_orderpriority, coalesce(label, o_orderpriority) AS label, coalesce(label, 'other') AS label_or_other
      FROM orders LEFT JOIN m ON o_orderpriority = priority""",
    "inline_rows_from_data": "SELECT p_partkey AS part_id, p_brand AS brand, p_name AS name FROM part",
    "map_literal_apply": """
      SELECT CASE l_returnflag WHEN 'A' THEN 'returned' WHEN 'N' THEN 'none' ELSE l_returnflag END AS flag_text, count(*) AS line_count
      FROM lineitem GROUP BY 1""",
    "source_identity": r"""
      SELECT page_id, regexp_replace(lower(CASE WHEN p = '' THEN url ELSE p END), '[^a-z0-9]+', '', 'g') AS identity
      FROM (SELECT page_id, url, regexp_extract(url, '([^/\\]+?)(?:\.[A-Za-z0-9_]+)?$', 1) AS p FROM pages)""",
    "preview_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "part_file_rows": "SELECT true AS has_files, count(*) AS \"rows\" FROM lineitem",
    "full_read": "SELECT * REPLACE (s_nationkey::BIGINT AS s_nationkey) FROM supplier",
    "file_view": "SELECT n_regionkey % 2 = 0 AS even_region, count(*) AS nations, min(n_name) AS first_name FROM nation GROUP BY 1",
    "repeated_load": """
      SELECT '007' AS _batch_id, count(*) AS "rows", sum(o_orderkey)::BIGINT AS keys, min(o_orderstatus) AS status FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'b8', count(*), sum(o_orderkey)::BIGINT, min(o_orderstatus) FROM orders WHERE o_orderstatus = 'O'""",
    "extract_header_files": """
      WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), good AS (SELECT * FROM c WHERE k % 7 <> 3)
      SELECT 'customers_' || k AS table_name, n::VARCHAR AS no_of_records, 'CustKey' AS field_name, 1::BIGINT AS position, n::VARCHAR AS no_of_symbols FROM good
      UNION ALL SELECT 'customers_' || k, n::VARCHAR, 'Größe', 2, '1' FROM good
      UNION ALL SELECT 'without header', NULL, NULL, NULL, NULL FROM c WHERE k % 7 = 3""",
    "fields_by_class": f"""
      WITH {PAGE_FIELDS} SELECT file_name AS table_name, inferred_category, count(*) AS field_count, string_agg(field_name, '|' ORDER BY position) AS field_names
      FROM classed GROUP BY ALL""",
    "extract_header_fields": f"""
      WITH {PAGE_FIELDS}
      SELECT file_name, table_name, no_of_records, position, field_name, tags, number_type,
             CAST((position - 1) * 8 AS VARCHAR) AS bit_offset, CAST(symbols AS VARCHAR) AS no_of_symbols FROM fields""",
    "source_structure": f"""
      WITH {PAGE_FIELDS} SELECT table_name, inferred_category, count(*) AS fields, count(DISTINCT file_name) AS files
      FROM classed GROUP BY ALL""",
    "schema_suggestion": f"""
      WITH {SUGGESTION} SELECT file_name, position, source_column, inferred_category, target_table, target_column, target_type,
             conversion_rule, confidence, review_status FROM mapped""",
    "schema_suggestion_summary": f"""
      WITH {SUGGESTION} SELECT count(*) AS total_columns, count(*) FILTER (review_status = 'AUTO_APPROVED') AS auto_approved_count,
             count(*) FILTER (review_status = 'NEEDS_REVIEW') AS needs_review_count, count(DISTINCT target_table) AS target_tables FROM mapped""",
    "mapping_errors": f"""
      WITH {SUGGESTION}, errors AS (
        SELECT 'target_table' AS field, 'target_table cannot be empty.' AS error FROM mapped WHERE trim(table_name) = ''
        UNION ALL SELECT 'review_status', 'Row must be approved before saving.' FROM mapped WHERE review_status = 'NEEDS_REVIEW'
        UNION ALL SELECT 'target_column', 'Duplicate target column.' FROM (
          SELECT 1 FROM mapped WHERE trim(table_name) <> '' AND target_column <> ''
          GROUP BY lower(trim(table_name)), lower(trim(target_column)) HAVING count(*) > 1))
      SELECT field, error, count(*) AS "rows" FROM errors GROUP BY ALL""",
    "drop_fields_after_concat": """
      WITH o AS (SELECT o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS amount FROM orders),
           l AS (SELECT l_orderkey AS orderkey, l_quantity AS quantity, l_extendedprice AS amount FROM lineitem),
           b AS (SELECT * FROM o UNION ALL BY NAME SELECT * FROM l)
      SELECT status, count(*) AS "rows", round(sum(amount), 2) AS amount, sum(quantity) AS quantity FROM b GROUP BY status
      UNION ALL BY NAME SELECT count(*) AS "rows", 'after drop: orderkey,amount' AS status FROM o""",
    "concat_widen": f"WITH {FACTS} SELECT * FROM fact UNION ALL BY NAME SELECT * FROM expenses",
    "concat_target": f"""WITH {FACTS} SELECT * FROM fact
      UNION ALL BY NAME SELECT "OrderKey", "YYYYMM" FROM expenses""",
    "plain_concat": """
      SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS balance FROM customer
      UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier""",
    "no_concatenate": """
      SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, 'suppliers' AS tables_after_drop""",
    "first_per_key": """
      SELECT user_id, event_id, event_type FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "metric_totals": """
      SELECT 'l_quantity' AS metric_name, round(sum(l_quantity), 2) AS metric_total FROM lineitem
      UNION ALL SELECT 'l_extendedprice', round(sum(l_extendedprice), 2) FROM lineitem
      UNION ALL SELECT 'l_discount', round(sum(l_discount), 2) FROM lineitem""",
    "previous_value": """
      SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_value FROM events""",
    "rowno": """
      SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders""",
    "recno": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rec_no FROM events",
    "peek": "SELECT event_id, user_id, lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS three_back FROM events",
    "latest_per_key": """
      SELECT o_custkey, o_orderkey, o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "recent_top20": """
      SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
    "multi_sort": "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    "stable_order": """
      SELECT o_custkey, o_orderkey, o_totalprice, 1::BIGINT AS "O_Extra", 'o_custkey,O_Extra,o_orderkey,o_totalprice' AS column_order, 0::BIGINT AS place FROM orders
      UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 2, 'o_custkey,O_Extra,o_orderkey,o_totalprice', 1 FROM orders""",
    "text_number_predicate": """
      WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS n FROM part)
      SELECT p_partkey, (n IS NULL OR n = '') AS name_eq_0, (n IS NOT NULL AND n <> '') AS name_gt_0,
             (n IS NOT NULL AND n <> '') AS name_ne_5, p_size > 25 AS size_gt_25 FROM p""",
    "history_flag": """
      SELECT CASE WHEN date_trunc('month', o_orderdate) <= DATE '1998-05-01' THEN 1 ELSE 0 END AS history_flag,
             count(*) AS orders, CAST(max(date_trunc('month', o_orderdate)) AS DATE) AS last_month FROM orders GROUP BY 1""",
    "conditional_if": """
      SELECT CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size_class, count(*) AS lines
      FROM lineitem GROUP BY 1""",
}
