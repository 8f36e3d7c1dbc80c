"""Queries for scalar functions (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload.functions import conditions as C
from ferryload.functions import dates as D
from ferryload.functions import numbers as N
from ferryload.functions import text as X
from ferryload.plans.tables import Tables


def month_functions(t: Tables):
    d = F.col("o_orderdate").cast("date")
    offsets = {"plus_1": 1, "plus_12": 12, "plus_24": 24, "minus_1": -1, "minus_12": -12}
    return t.orders.select(
        "o_orderkey", *[D.add_months(d, n).alias(name) for name, n in offsets.items()],
        D.format_date(d, "YYYYMM").alias("yyyymm"), D.format_date(d, "YYYY-MM-DD").alias("iso"),
        D.format_date(d, "DD/MM/YYYY").alias("slashes"), D.month_start(d).alias("month_start"), D.month_name(d).alias("month_name"),
    )


def date_parts(t: Tables):
    parts = ["year", "month", "day", "hour", "minute", "second"]
    return t.events.select("event_id", *[D.date_part(F.col("ts"), p).cast("bigint").alias(p) for p in parts])


def date_from_parts(t: Tables):
    y, m, d = F.lit(1995) + F.col("p_size") % 7, F.col("p_size") % 14, F.col("p_partkey") % 32
    return t.part.select(
        "p_partkey", D.make_date(y, m, d).alias("made"), D.to_date(F.col("p_name")).alias("unreadable"), D.today("2013-05-31").alias("as_of"),
    )


def yyyymm_shift(t: Tables):
    month = F.date_format("o_orderdate", "yyyyMM")
    spoiled = F.when(F.col("o_orderkey") % 10 == 0, F.lit("199713")).when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).otherwise(month)
    return t.orders.select(
        "o_orderkey", D.yyyymm_to_date(spoiled).alias("month_date"), D.yyyymm_to_date(month.cast("int")).alias("from_int"),
        D.shift_yyyymm(spoiled, 12).alias("next_year"), D.shift_yyyymm(month, -1).alias("last_month"),
        D.shift_yyyymm(month, 1, as_text=False).alias("next_month_date"),
    )


def month_region_key(t: Tables):
    region = F.when(F.col("o_custkey") % 9 == 0, None).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", D.month_region_key(region, F.col("o_orderdate").cast("date"), 12).alias("month_region_key"))


def serial_date(t: Tables):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("unknown")).otherwise(F.concat(serial.cast("string"), F.lit(".75")))
    return t.orders.select("o_orderkey", D.serial_to_date(serial).alias("from_number"), D.serial_to_date(text).alias("from_text"))


def timestamp_text(t: Tables):
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    read = D.to_timestamp(text)
    return t.events.groupBy(read.isNull().alias("is_unreadable")).agg(F.count("*").alias("events"), F.max(read.cast("date")).alias("last_day"))


def string_functions(t: Tables):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", X.ampersand(F.col("p_brand"), "|", F.when(F.col("p_size") > 10, n)).alias("joined"), X.upper(n).alias("upper_name"),
        X.lower(F.col("p_type")).alias("lower_type"), X.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"),
        X.length(n).cast("bigint").alias("len"), X.left(n, 3).alias("left3"), X.right(n, 4).alias("right4"), X.mid(n, 2, 3).alias("mid23"),
        X.mid(n, 4).alias("mid4"), X.index(n, "e").cast("bigint").alias("index_e"), X.replace(n, "red", "RED").alias("replaced"),
        X.as_text(F.col("p_size")).alias("size_text"),
    )


def match_wildmatch(t: Tables):
    return t.part.select(
        "p_partkey", X.match(F.col("p_type"), "SMALL", "LARGE", "PROMO").cast("bigint").alias("type_match"),
        X.wild_match(F.col("p_name"), "RED*", "*gear", "b?ue *").cast("bigint").alias("name_match"),
    )


def value_kinds(t: Tables):
    text = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).when(F.col("p_size") % 4 == 1, F.lit("  ")).when(F.col("p_size") % 4 == 2, None).otherwise(F.col("p_retailprice").cast("string"))
    return t.part.select(
        "p_partkey", C.is_null(text).alias("is_null"), X.is_empty(text).alias("is_empty"), X.is_textual(text).alias("is_textual"),
        X.is_numeric(text).alias("is_numeric"), C.first_known(text, F.lit("none")).alias("known"),
    )


def number_functions(t: Tables):
    p = F.col("l_extendedprice")
    text = F.when(F.col("l_linenumber") == 1, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.sum(N.floor(p)).alias("floors"), F.sum(N.ceil(p)).alias("ceils"), F.round(F.sum(N.round_to(p, 1)), 1).alias("rounds"),
        F.sum(N.num(F.col("l_quantity").cast("int").cast("string"), "int")).alias("nums"), F.sum(N.text_number(text) * 2).alias("doubled"),
        F.count(N.num(text, "int")).alias("readable_ints"),
    )


QUERIES = {f.__name__: f for f in (
    month_functions, date_parts, date_from_parts, yyyymm_shift, month_region_key, serial_date, timestamp_text, string_functions,
    match_wildmatch, value_kinds, number_functions,
)}

ORACLE = {
    "month_functions": """
      WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
      SELECT o_orderkey, CAST(d + INTERVAL 1 MONTH AS DATE) AS plus_1, CAST(d + INTERVAL 12 MONTH AS DATE) AS plus_12,
             CAST(d + INTERVAL 24 MONTH AS DATE) AS plus_24, CAST(d - INTERVAL 1 MONTH AS DATE) AS minus_1, CAST(d - INTERVAL 12 MONTH AS DATE) AS minus_12,
             strftime(d, '%Y%m') AS yyyymm, strftime(d, '%Y-%m-%d') AS iso, strftime(d, '%d/%m/%Y') AS slashes,
             CAST(date_trunc('month', d) AS DATE) AS month_start, strftime(d, '%b') AS month_name FROM d""",
    "date_parts": """
      SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second FROM events""",
    "date_from_parts": """
      SELECT p_partkey, try_cast(printf('%04d-%02d-%02d', 1995 + p_size % 7, p_size % 14, p_partkey % 32) AS DATE) AS made,
             CAST(NULL AS DATE) AS unreadable, DATE '2013-05-31' AS as_of FROM part""",
    "yyyymm_shift": """
      WITH m AS (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, (o_orderkey % 10 = 0 OR o_orderkey % 11 = 0) AS spoiled FROM orders)
      SELECT o_orderkey, CASE WHEN NOT spoiled THEN d END AS month_date, d AS from_int,
             CASE WHEN NOT spoiled THEN strftime(d + INTERVAL 12 MONTH, '%Y%m') END AS next_year,
             strftime(d - INTERVAL 1 MONTH, '%Y%m') AS last_month, CAST(d + INTERVAL 1 MONTH AS DATE) AS next_month_date FROM m""",
    "month_region_key": """
      SELECT o_orderkey, CASE WHEN o_custkey % 9 <> 0 THEN o_orderpriority END || '_' || strftime(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH, '%Y%m') AS month_region_key FROM orders""",
    "serial_date": """
      SELECT o_orderkey, DATE '1899-12-30' + CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS INTEGER) AS from_number,
             CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS from_text FROM orders""",
    "timestamp_text": """
      SELECT event_id % 5 = 0 AS is_unreadable, count(*) AS events, CAST(max(CASE WHEN event_id % 5 <> 0 THEN ts END) AS DATE) AS last_day FROM events GROUP BY 1""",
    "string_functions": """
      SELECT p_partkey, p_brand || '|' || CASE WHEN p_size > 10 THEN p_name END AS joined, upper(p_name) AS upper_name, lower(p_type) AS lower_type,
             trim('  ' || p_name || ' ') AS trimmed, length(p_name) AS len, left(p_name, 3) AS left3, right(p_name, 4) AS right4,
             substring(p_name, 2, 3) AS mid23, substring(p_name, 4) AS mid4, CAST(instr(p_name, 'e') AS BIGINT) AS index_e,
             replace(p_name, 'red', 'RED') AS replaced, CAST(p_size AS VARCHAR) AS size_text FROM part""",
    "match_wildmatch": """
      SELECT p_partkey, CAST(coalesce(list_position(['SMALL', 'LARGE', 'PROMO'], p_type), 0) AS BIGINT) AS type_match,
             CAST(CASE WHEN p_name ILIKE 'red%' THEN 1 WHEN p_name ILIKE '%gear' THEN 2 WHEN p_name ILIKE 'b_ue %' THEN 3 ELSE 0 END AS BIGINT) AS name_match FROM part""",
    "value_kinds": """
      WITH v AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS x FROM part)
      SELECT p_partkey, x IS NULL AS is_null, (x IS NULL OR trim(x) = '') AS is_empty, (x IS NOT NULL AND try_cast(x AS DOUBLE) IS NULL) AS is_textual,
             (x IS NOT NULL AND try_cast(x AS DOUBLE) IS NOT NULL) AS is_numeric, coalesce(x, 'none') AS known FROM v""",
    "number_functions": """
      SELECT l_suppkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS floors, CAST(sum(ceil(l_extendedprice)) AS BIGINT) AS ceils,
             round(sum(round(l_extendedprice, 1)), 1) AS rounds, CAST(sum(l_quantity) AS BIGINT) AS nums,
             sum(CASE WHEN l_linenumber <> 1 THEN l_quantity END) * 2 AS doubled, count(*) FILTER (l_linenumber < 0) AS readable_ints
      FROM lineitem GROUP BY 1""",
}
