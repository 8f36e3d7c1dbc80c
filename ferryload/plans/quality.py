"""Queries for typed conversion, profiles and checks (T5-T17, Q*, S13, S17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload.operators import checks, combine, conversion, profiling
from ferryload.plans.loading import _facts
from ferryload.plans.tables import Tables
from ferryload.sources import sinks

MAPPING = [
    {"source_column": "OrderKey", "target_column": "order_key", "target_type": "STRING", "conversion_rule": "cast_string"},
    {"source_column": "OrderDate", "target_column": "order_date", "target_type": "DATE", "conversion_rule": "qlik_serial_to_date"},
    {"source_column": "Customer Name", "target_column": "customer_name", "target_type": "STRING", "conversion_rule": "cast_string"},
    {"source_column": "IsActive", "target_column": "is_active", "target_type": "BOOLEAN", "conversion_rule": "flag_to_boolean_or_int_review"},
    {"source_column": "Units", "target_column": "units", "target_type": "BIGINT", "conversion_rule": "cast_bigint"},
    {"source_column": "Amount", "target_column": "amount", "target_type": "DECIMAL(18,2)", "conversion_rule": "cast_decimal_18_2"},
    {"source_column": "Rate", "target_column": "rate", "target_type": "DOUBLE", "conversion_rule": "cast_double"},
    {"source_column": "Level", "target_column": "level", "target_type": "INT", "conversion_rule": "flag_to_boolean_or_int_review"},
    {"source_column": "Note", "target_column": "note", "target_type": "STRING", "conversion_rule": "no_rule_review"},
    {"source_column": "Absent", "target_column": "absent", "target_type": "DATE", "conversion_rule": "qlik_serial_to_date"},
]
for _row in MAPPING:
    _row["target_table"] = "orders_raw"
INGESTED_AT = "2024-01-01 00:00:00"


def extract_rows(t: Tables):
    """Orders as an extract delivers them: everything as text, with some unreadable cells."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    words = F.array(*[F.lit(w) for w in ("1", "0", "Yes", " no", "TRUE", "false", "maybe", "")])
    return t.orders.select(
        key.alias("OrderKey"),
        F.when(key % 13 == 0, "soon").otherwise(serial).alias("OrderDate"),
        F.concat(F.lit("Customer "), "o_custkey").alias("Customer Name"),
        F.element_at(words, (key % 8 + 1).cast("int")).alias("IsActive"),
        F.concat((key % 40).cast("string"), F.when(key % 3 == 0, ".0").when(key % 17 == 0, ".5").otherwise("")).alias("Units"),
        F.when(key % 19 == 0, "n/a").otherwise(F.concat(price.cast("string"), F.lit("5"))).alias("Amount"),
        F.when(key % 4 == 0, None).otherwise((key / 8).cast("string")).alias("Rate"),
        F.substring("o_orderpriority", 1, 1).alias("Level"), F.col("o_orderpriority").alias("Note"), F.col("_metadata"),
    )


def _converted(t: Tables):
    return conversion.convert_table(extract_rows(t), MAPPING, "batch-1", INGESTED_AT)[0]


def convert_typed(t: Tables):
    rows = _converted(t)
    return rows.select(
        *[F.col(c) for c in rows.columns if c not in ("_source_file_path", "_ingestion_timestamp", "_record_hash", "amount", "level")],
        F.col("amount").cast("double").alias("amount"), F.col("level").cast("bigint").alias("level"),
        F.col("_ingestion_timestamp").cast("date").alias("ingested_on"),
    )


def flag_to_boolean(t: Tables):
    rows = _converted(t)
    return rows.groupBy("is_active").agg(F.count("*").alias("rows"))


def record_hash(t: Tables):
    rows = t.orders.select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("order_key"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("order_date"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"),
    )
    return rows.select("order_key", conversion.record_hash(rows.columns).alias("record_hash"))


def typed_rows(t: Tables):
    mapping = [{"target_column": "o_orderkey", "target_type": "INT"}, {"target_column": "o_totalprice", "target_type": "DECIMAL(18,2)"},
               {"target_column": "o_orderdate", "target_type": "DATE"}, {"target_column": "o_orderpriority", "target_type": "BIGINT"}]
    rows = sinks.typed_rows(t.orders, mapping, "b7")
    return rows.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"),
        "o_orderdate", "o_orderpriority", "_source_file_name", "_batch_id", "_record_hash",
    )


def _approved(t: Tables):
    return t.spark.createDataFrame([(m["source_column"], m["target_type"]) for m in MAPPING], "source_column string, target_type string")


def _profiled(t: Tables):
    return profiling.profile(extract_rows(t).drop("_metadata"), _approved(t))


def column_profile(t: Tables):
    orders = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return profiling.profile(orders).withColumn("sample_values", F.array_join("sample_values", "|"))


def profile_match_status(t: Tables):
    return _profiled(t).select(
        "column_name", "null_count", "distinct_count", F.array_join("sample_values", "|").alias("sample_values"), "detected_runtime_type",
        "approved_target_type", "type_match_status", "warning_reason",
    )


def profile_summary(t: Tables):
    return profiling.profile_summary(_profiled(t))


def quick_profile(t: Tables):
    return profiling.quick_profile(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


def _checked(t: Tables):
    key = F.col("order_key").cast("bigint")
    return _converted(t).drop("_batch_id", "note").select(
        "*", F.lit(1).alias("unplanned"),
    ).withColumn("is_active", F.when(key % 100 == 0, "perhaps").otherwise(F.col("is_active").cast("string"))).withColumn(
        "order_date", F.when(key % 50 == 1, "44197").otherwise(F.col("order_date").cast("string"))
    ).withColumn("units", F.when(key % 40 == 3, "three").otherwise(F.col("units").cast("string")))


def quality_checks(t: Tables):
    return checks.output_checks(_checked(t), MAPPING, t.orders.count())


def check_verdict(t: Tables):
    good = checks.output_checks(_converted(t), MAPPING)
    bad = checks.output_checks(_checked(t), MAPPING)
    named = lambda df, name: checks.overall_status(df).withColumn("output", F.lit(name))
    return named(good, "good").unionByName(named(bad, "bad"))


def null_pct(t: Tables):
    return checks.null_percentages(_converted(t), [m["target_column"] for m in MAPPING])


def not_null(t: Tables):
    all_rows = checks.not_null(_converted(t), "rate", "rate_known")
    some = checks.not_null(_converted(t), "rate", "rate_known_where_odd", F.col("order_key").cast("bigint") % 2 == 1)
    return checks.stack(all_rows, some, checks.non_empty(t.lineitem, "lineitem_has_rows"), checks.non_empty(t.lineitem.where("l_quantity < 0"), "negative_lines"))


def duplicate_keys(t: Tables):
    return checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def union_parity(t: Tables):
    fact, expenses = _facts(t)
    whole = combine.concatenate_into(fact, expenses, ["OrderKey"])
    short = combine.concatenate(fact, expenses.where(F.col("Account") != "N"))
    return checks.stack(checks.union_parity(fact, expenses, whole), checks.union_parity(fact, expenses, short, "union_parity_short"))


def field_parity(t: Tables):
    fact, expenses = _facts(t)
    listed = ["OrderKey"]
    whole = combine.concatenate_into(fact, expenses, listed)
    widened = combine.concatenate(fact, expenses)
    return checks.field_parity(fact, expenses, listed, whole).withColumn("load", F.lit("target")).unionByName(
        checks.field_parity(fact, expenses, listed, widened).withColumn("load", F.lit("widened")))


def join_key_checks(t: Tables):
    return checks.join_key_issues(t.orders, t.customer, "O_CUSTKEY", "c_custkey").unionByName(
        checks.join_key_issues(t.customer.where("c_nationkey > 4"), t.nation, "c_nationkey", "n_name")).unionByName(
        checks.join_key_issues(t.orders, t.customer.where("c_custkey % 5 = 0"), "o_custkey", "c_custkey")).unionByName(
        checks.join_key_issues(t.lineitem, t.orders, "l_order", "o_orderkey"))


def line_facts(t: Tables):
    """Q1 without distinct values: one pass over all columns of the lines."""
    lines = t.lineitem.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    facts = profiling.column_facts(lines, LINE_COLUMNS)
    return facts.select("column_name", "row_count_checked", "null_count", "non_null_count", "min_value", "max_value",
                        profiling.runtime_type(F.lit("")).alias("detected_runtime_type"))


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate"]


def load_status(t: Tables):
    same = checks.load_status(t.orders, t.orders.select("o_orderkey"))
    return same.unionByName(checks.load_status(t.orders, t.orders.where("o_orderstatus <> 'F'")))


def branch_ownership(t: Tables):
    fact, expenses = _facts(t)
    both = combine.concatenate(fact.withColumn("branch", F.lit("fact")), expenses.withColumn("branch", F.lit("expenses")))
    leak = both.unionByName(fact.limit(0).withColumn("branch", F.lit("leak")), allowMissingColumns=True)
    spoiled = leak.withColumn("Account", F.when((F.col("branch") == "fact") & (F.col("CustKey") % 50 == 0), "X").otherwise(F.col("Account")))
    return checks.branch_ownership(spoiled, "branch", {"fact": ["CustKey"], "expenses": ["Account"]})


def cardinality(t: Tables):
    return checks.cardinality(t.orders, "o_custkey", t.customer, "c_custkey").unionByName(
        checks.cardinality(t.nation, "n_nationkey", t.supplier, "s_nationkey")
    ).unionByName(checks.cardinality(t.lineitem, "l_orderkey", t.lineitem, "l_orderkey")).unionByName(
        checks.cardinality(t.customer, "c_custkey", t.customer, "c_custkey")
    )


def grain_keys(t: Tables):
    return checks.grain_keys(t.lineitem, [["l_orderkey"], ["l_orderkey", "l_linenumber"]]).unionByName(
        checks.grain_keys(t.conversations, [["conv_id"], ["conv_id", "turn"]])
    ).select("key_columns", F.col("key_count").cast("bigint").alias("key_count"), "repeated_keys", "is_grain")


def smallest_grain(t: Tables):
    found = checks.smallest_grain(t.conversations, [["conv_id", "role", "turn"], ["turn"], ["conv_id"], ["conv_id", "turn"]])
    return found.select("key_columns", F.col("key_count").cast("bigint").alias("key_count"), "repeated_keys", "is_grain")


QUERIES = {f.__name__: f for f in (
    convert_typed, flag_to_boolean, record_hash, typed_rows, column_profile, profile_match_status, profile_summary, quick_profile,
    quality_checks, check_verdict, null_pct, not_null, duplicate_keys, union_parity, field_parity, join_key_checks, line_facts, load_status, branch_ownership, cardinality, grain_keys,
    smallest_grain,
)}

RAW = """
raw AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS "OrderKey",
    CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) - DATE '1899-12-30' AS VARCHAR) END AS "OrderDate",
    'Customer ' || o_custkey AS "Customer Name", ['1', '0', 'Yes', ' no', 'TRUE', 'false', 'maybe', ''][o_orderkey % 8 + 1] AS "IsActive",
    (o_orderkey % 40) || CASE WHEN o_orderkey % 3 = 0 THEN '.0' WHEN o_orderkey % 17 = 0 THEN '.5' ELSE '' END AS "Units",
    CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) || '5' END AS "Amount",
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey / 8 AS VARCHAR) END AS "Rate",
    left(o_orderpriority, 1) AS "Level", o_orderpriority AS "Note", CAST(o_orderdate AS DATE) AS d, o_totalprice AS p
  FROM orders
),
conv AS (
  SELECT k, "OrderKey" AS order_key, CASE WHEN "OrderDate" <> 'soon' THEN d END AS order_date, "Customer Name" AS customer_name,
    CASE lower(trim("IsActive")) WHEN '1' THEN true WHEN 'yes' THEN true WHEN 'true' THEN true WHEN '0' THEN false WHEN 'no' THEN false WHEN 'false' THEN false END AS is_active,
    CASE WHEN "Units" NOT LIKE '%.5' THEN k % 40 END AS units,
    CAST(CAST(CASE WHEN "Amount" <> 'n/a' THEN "Amount" END AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST("Rate" AS DOUBLE) AS rate,
    CAST("Level" AS BIGINT) AS level, "Note" AS note, CAST(NULL AS DATE) AS absent
  FROM raw
)"""

_KINDS = {"OrderKey": "STRING", "OrderDate": "DATE", "Customer Name": "STRING", "IsActive": "BOOLEAN", "Units": "BIGINT",
          "Amount": "DECIMAL(18,2)", "Rate": "DOUBLE", "Level": "INT", "Note": "STRING"}


def profile_sql(source: str, column: str, approved: str = "", numeric: bool = False) -> str:
    """One profile row of a column of a relation, in SQL."""
    low, high = (f'CAST(min("{column}") AS VARCHAR)', f'CAST(max("{column}") AS VARCHAR)') if numeric else ("min(x)", "max(x)")
    number = r"regexp_full_match(trim(x), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?')"
    return f"""
      SELECT '{column}' AS column_name, count(*) AS row_count_checked, count(*) - count(x) AS null_count, count(x) AS non_null_count,
        count(DISTINCT x) AS distinct_count,
        coalesce((SELECT string_agg(y, '|' ORDER BY y) FROM (SELECT DISTINCT CAST("{column}" AS VARCHAR) AS y FROM {source}
                   WHERE trim(CAST("{column}" AS VARCHAR)) <> '' ORDER BY y LIMIT 5)), '') AS sample_values,
        coalesce({low}, '') AS min_value, coalesce({high}, '') AS max_value,
        CASE WHEN count(x) = 0 THEN 'STRING'
             WHEN '{approved}' = 'DATE' AND bool_and({number} AND try_cast(x AS DOUBLE) BETWEEN 20000 AND 80000) THEN 'QLIK_DATE_SERIAL'
             WHEN bool_and(lower(trim(x)) IN ('0', '1', 'true', 'false', 'y', 'n')) THEN 'BOOLEAN_LIKE'
             WHEN bool_and({number} AND try_cast(x AS DOUBLE) = floor(try_cast(x AS DOUBLE))) THEN 'INTEGER'
             WHEN bool_and({number}) THEN 'DECIMAL' ELSE 'STRING' END AS detected_runtime_type,
        '{approved}' AS approved_target_type
      FROM (SELECT *, CASE WHEN trim(CAST("{column}" AS VARCHAR)) <> '' THEN CAST("{column}" AS VARCHAR) END AS x FROM {source})"""


STATUS = """
  SELECT *, CASE WHEN approved_target_type = '' THEN 'NEEDS_REVIEW'
      WHEN fits THEN 'MATCH' WHEN detected_runtime_type = 'BOOLEAN_LIKE' THEN 'NEEDS_REVIEW' ELSE 'MISMATCH' END AS type_match_status,
    CASE WHEN approved_target_type = '' THEN 'No approved mapping target type found for this source column.' WHEN fits THEN ''
      WHEN detected_runtime_type = 'BOOLEAN_LIKE' THEN 'Boolean-like values may need target type review.'
      WHEN detected_runtime_type = 'QLIK_DATE_SERIAL' THEN 'Qlik date serial values do not match approved target type.'
      ELSE upper(left(detected_runtime_type, 1)) || lower(detected_runtime_type[2:]) || ' runtime values do not match approved target type.' END AS warning_reason
  FROM (SELECT *, CASE detected_runtime_type WHEN 'QLIK_DATE_SERIAL' THEN approved_target_type = 'DATE' WHEN 'BOOLEAN_LIKE' THEN approved_target_type = 'BOOLEAN'
      WHEN 'INTEGER' THEN approved_target_type IN ('INT', 'BIGINT') WHEN 'DECIMAL' THEN approved_target_type IN ('DOUBLE', 'DECIMAL(18,2)')
      ELSE approved_target_type = 'STRING' END AS fits FROM prof)"""

_ORDERS_PROFILE = " UNION ALL ".join(profile_sql("o", c, "", n) for c, n in (
    ("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)))
_RAW_PROFILE = " UNION ALL ".join(profile_sql("raw", c, k) for c, k in _KINDS.items())

CHECKED = f"""
checked AS (SELECT k, CASE WHEN k % 100 = 0 THEN 'perhaps' ELSE CAST(is_active AS VARCHAR) END AS is_active,
  CASE WHEN k % 50 = 1 THEN '44197' ELSE CAST(order_date AS VARCHAR) END AS order_date,
  CASE WHEN k % 40 = 3 THEN 'three' ELSE CAST(units AS VARCHAR) END AS units, amount, rate, level FROM conv),
figures AS (SELECT count(*) AS n, count(*) FILTER (order_date = '44197') AS dates, count(*) FILTER (is_active = 'perhaps') AS flags,
  count(*) FILTER (units = 'three') AS numbers FROM checked)"""


def check_sql(check_id: str, check_type: str, expected: str, actual: str, source: str) -> str:
    return f"""SELECT '{check_id}' AS check_id, '{check_type}' AS check_type, CAST({expected} AS DOUBLE) AS expected, CAST({actual} AS DOUBLE) AS actual,
      CAST({actual} AS DOUBLE) - CAST({expected} AS DOUBLE) AS difference, CASE WHEN {actual} = {expected} THEN 'passed' ELSE 'failed' END AS status FROM {source}"""


_CHECKS = " UNION ALL ".join([
    check_sql("column_count", "schema", "15", "14", "figures"), check_sql("approved_target_columns_exist", "schema", "0", "1", "figures"),
    check_sql("audit_columns_exist", "schema", "0", "1", "figures"), check_sql("row_count", "row_count", "(SELECT count(*) FROM orders)", "n", "figures"),
    check_sql("date_conversion", "values", "0", "dates", "figures"), check_sql("boolean_values", "values", "0", "flags", "figures"),
    check_sql("numeric_values", "values", "0", "numbers", "figures"),
])

def _names_sql(check_id: str, names: str, load: str = "") -> str:
    count = len([n for n in names.split(", ") if n])
    return f"""SELECT '{check_id}' AS check_id, 'names' AS check_type, 0::DOUBLE AS expected, {count}::DOUBLE AS actual, {count}::DOUBLE AS difference,
      '{"failed" if count else "passed"}' AS status, '{names}' AS names""" + (f", '{load}' AS load" if load else "")


def _unmatched_sql(lost: str) -> str:
    return f"""SELECT 'JOIN_KEY_UNMATCHED', 'values', 0, n, n, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END, '' FROM (SELECT count(*)::DOUBLE AS n FROM {lost})"""


ORACLE = {
    "field_parity": " UNION ALL ".join([
        _names_sql("CONCATENATE_FIELD_PARITY_MISMATCH", "", "target"), _names_sql("CONCATENATE_SOURCE_ONLY_FIELD_LEAK", "", "target"),
        _names_sql("CONCATENATE_FIELD_PARITY_MISMATCH", "Account", "widened"), _names_sql("CONCATENATE_SOURCE_ONLY_FIELD_LEAK", "Account", "widened")]),
    "join_key_checks": " UNION ALL ".join([
        *[_names_sql(c, "") for c in ("JOIN_KEY_MISSING_LEFT", "JOIN_KEY_MISSING_RIGHT", "JOIN_KEY_TO_TEXT")] * 2,
        _unmatched_sql("orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        _unmatched_sql("orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)"),
        _names_sql("JOIN_KEY_MISSING_LEFT", ""), _names_sql("JOIN_KEY_MISSING_RIGHT", ""), _names_sql("JOIN_KEY_TO_TEXT", "c_nationkey = n_name"),
        _unmatched_sql("customer WHERE c_nationkey > 4"),
        _names_sql("JOIN_KEY_MISSING_LEFT", "l_order"), _names_sql("JOIN_KEY_MISSING_RIGHT", ""), _names_sql("JOIN_KEY_TO_TEXT", "")]),
    "line_facts": "WITH l AS (SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem) " + " UNION ALL ".join(
        "SELECT column_name, row_count_checked, null_count, non_null_count, min_value, max_value, detected_runtime_type FROM ("
        + profile_sql("l", c, "", c not in ("l_returnflag", "l_linestatus", "l_shipdate")) + ")" for c in LINE_COLUMNS),
    "convert_typed": f"""
      WITH {RAW} SELECT order_key, order_date, customer_name, is_active, units, amount, rate, level, note, absent,
        'orders.parquet' AS "_source_file_name", 'batch-1' AS "_batch_id", DATE '2024-01-01' AS ingested_on FROM conv""",
    "flag_to_boolean": f'WITH {RAW} SELECT is_active, count(*) AS "rows" FROM conv GROUP BY 1',
    "record_hash": """
      SELECT o_orderkey AS order_key, sha256(CAST(json_object('is_urgent', o_orderpriority = '1-URGENT',
        'order_date', CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, 'order_key', o_orderkey, 'status', o_orderstatus) AS VARCHAR)) AS record_hash
      FROM orders""",
    "typed_rows": """
      SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(NULL AS BIGINT) AS o_orderpriority,
        'orders.parquet' AS "_source_file_name", 'b7' AS "_batch_id", CAST(NULL AS VARCHAR) AS "_record_hash" FROM orders""",
    "column_profile": f"""
      WITH o AS (SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders), prof AS ({_ORDERS_PROFILE})
      SELECT * EXCLUDE (fits) FROM ({STATUS})""",
    "profile_match_status": f"""
      WITH {RAW}, prof AS ({_RAW_PROFILE}) SELECT column_name, null_count, distinct_count, sample_values, detected_runtime_type, approved_target_type,
        type_match_status, warning_reason FROM ({STATUS})""",
    "profile_summary": f"""
      WITH {RAW}, prof AS ({_RAW_PROFILE}) SELECT count(*) AS total_columns, max(row_count_checked) AS rows_checked,
        count(*) FILTER (type_match_status = 'MATCH') AS match_count, count(*) FILTER (type_match_status = 'NEEDS_REVIEW') AS needs_review_count,
        count(*) FILTER (type_match_status = 'MISMATCH') AS mismatch_count FROM ({STATUS})""",
    "quick_profile": """
      SELECT 'l_returnflag' AS column_name, count(*) AS row_count_checked, count(l_returnflag) AS non_null_count, count(DISTINCT l_returnflag) AS approx_distinct_count FROM lineitem
      UNION ALL SELECT 'l_linestatus', count(*), count(l_linestatus), count(DISTINCT l_linestatus) FROM lineitem
      UNION ALL SELECT 'l_linenumber', count(*), count(l_linenumber), count(DISTINCT l_linenumber) FROM lineitem""",
    "quality_checks": f"WITH {RAW}, {CHECKED} {_CHECKS}",
    "check_verdict": f"""
      WITH {RAW}, {CHECKED}, c AS ({_CHECKS})
      SELECT count(*) AS total_checks, count(*) FILTER (status = 'passed') AS passed_checks,
        CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'passed' END AS overall_status, 'bad' AS output FROM c
      UNION ALL SELECT 7, CASE WHEN count(*) > 0 THEN 7 END, 'passed', 'good' FROM conv""",
    "null_pct": f"WITH {RAW} " + " UNION ALL ".join(
        f"""SELECT '{m["target_column"]}' AS column_name, count(*) - count({m["target_column"]}) AS null_count, count(*) AS row_count,
          round((count(*) - count({m["target_column"]})) * 100.0 / count(*), 2) AS null_percentage,
          (count(*) - count({m["target_column"]})) * 100.0 / count(*) >= 25 AS warning FROM conv""" for m in MAPPING),
    "not_null": f"WITH {RAW}, f AS (SELECT count(*) FILTER (rate IS NULL) AS a, count(*) FILTER (rate IS NULL AND k % 2 = 1) AS b FROM conv) " + " UNION ALL ".join([
        check_sql("rate_known", "not_null", "0", "a", "f"), check_sql("rate_known_where_odd", "not_null", "0", "b", "f"),
        check_sql("lineitem_has_rows", "non_empty", "1", "n", "(SELECT least(count(*), 1) AS n FROM lineitem)"),
        check_sql("negative_lines", "non_empty", "1", "n", "(SELECT least(count(*), 1) AS n FROM lineitem WHERE l_quantity < 0)")]),
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "union_parity": """WITH n AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM lineitem) AS b,
        (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'N') AS c) """ + " UNION ALL ".join([
        check_sql("union_parity", "row_count", "(a + b)", "(a + b)", "n"), check_sql("union_parity_short", "row_count", "(a + b)", "(a + c)", "n")]),
    "load_status": """
      SELECT count(*) AS source_rows, count(*) AS loaded_rows, true AS is_match, 'success' AS status FROM orders
      UNION ALL SELECT count(*), count(*) FILTER (o_orderstatus <> 'F'), false, 'completed_with_warnings' FROM orders""",
    "branch_ownership": """
      SELECT 'fact' AS branch, count(*) FILTER (o_custkey % 50 = 0) AS foreign_cells, 'failed' AS status FROM orders
      UNION ALL SELECT 'expenses', count(*) FILTER (l_orderkey IS NULL), 'passed' FROM lineitem""",
    "cardinality": """
      WITH s AS (
        SELECT 'o_custkey' AS left_key, 'c_custkey' AS right_key, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS max_left,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)) AS max_right
        UNION ALL SELECT 'n_nationkey', 's_nationkey', (SELECT max(n) FROM (SELECT count(*) AS n FROM nation GROUP BY n_nationkey)),
               (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey))
        UNION ALL SELECT 'l_orderkey', 'l_orderkey', (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)),
               (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))
        UNION ALL SELECT 'c_custkey', 'c_custkey', (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)),
               (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)))
      SELECT *, CASE WHEN max_left > 1 AND max_right > 1 THEN '*:*' WHEN max_left > 1 THEN '*:1' WHEN max_right > 1 THEN '1:*' ELSE '1:1' END AS cardinality,
        max_right <= 1 AS is_safe, CASE WHEN max_left > 1 AND max_right > 1 THEN 'aggregate_before_join' WHEN max_right > 1 THEN 'pivot_before_join' END AS required_action
      FROM s""",
    "smallest_grain": """
      SELECT 'conv_id,turn' AS key_columns, 2::BIGINT AS key_count, count(*) FILTER (n > 1) AS repeated_keys, max(n) = 1 AS is_grain
      FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id, turn)""",
    "grain_keys": "SELECT key_columns, key_count, count(*) FILTER (n > 1) AS repeated_keys, max(n) = 1 AS is_grain FROM ("
        + " UNION ALL ".join(
            f"SELECT '{','.join(keys)}' AS key_columns, CAST({len(keys)} AS BIGINT) AS key_count, count(*) AS n FROM {table} GROUP BY {','.join(keys)}"
            for table, keys in (("lineitem", ["l_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("conversations", ["conv_id"]), ("conversations", ["conv_id", "turn"])))
        + ") GROUP BY ALL",
}
