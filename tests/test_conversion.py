"""Conversion, profile and check fixtures."""

import datetime as dt
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ferryload.fixed_values import AUDIT_COLUMNS
from ferryload.operators import checks, conversion, profiling

MAPPING = [
    {"source_column": "OrderDate", "target_table": "t", "target_column": "order_date", "target_type": "DATE", "conversion_rule": "qlik_serial_to_date"},
    {"source_column": "Customer Name", "target_table": "t", "target_column": "customer_name", "target_type": "STRING", "conversion_rule": "cast_string"},
    {"source_column": "IsActive", "target_table": "t", "target_column": "is_active", "target_type": "BOOLEAN", "conversion_rule": "flag_to_boolean_or_int_review"},
    {"source_column": "Amount", "target_table": "t", "target_column": "amount", "target_type": "DECIMAL(18,2)", "conversion_rule": "cast_decimal_18_2"},
]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "orders")
    rows = [(44197, "A", 1, "10.50"), (44198, "B", 0, "12.75"), (None, None, 7, "ten")]
    spark.createDataFrame(rows, "OrderDate bigint, `Customer Name` string, IsActive int, Amount string").write.parquet(path)
    return spark.read.parquet(path)


def test_conversion_round_trip(spark, source, tmp_path):
    seen = Observation("conversion")
    rows, warnings = conversion.convert_table(source, [*MAPPING, {**MAPPING[0], "source_column": "Gone", "target_column": "gone"}], "b1", "2024-01-01 00:00:00", seen)
    rows.write.parquet(str(tmp_path / "out"))
    back = {r["customer_name"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back["A"]["order_date"] == dt.date(2021, 1, 1) and back["B"]["order_date"] == dt.date(2021, 1, 2)
    assert (back["A"]["is_active"], back["B"]["is_active"], back[None]["is_active"]) == (True, False, None)
    assert back["A"]["amount"] == Decimal("10.50") and back["A"]["gone"] is None
    assert all(back["A"][c] is not None for c in AUDIT_COLUMNS) and len(back["A"]["_record_hash"]) == 64
    assert seen.get["row_count"] == 3 and (seen.get["is_active"], seen.get["amount"], seen.get["order_date"]) == (1, 1, 0)
    assert len(warnings) == 1 and "Gone" in warnings[0]


def test_conversion_needs_one_target(source):
    with pytest.raises(ValueError):
        conversion.convert_table(source, [MAPPING[0], {**MAPPING[1], "target_table": "u"}], "b", "2024-01-01 00:00:00")


def test_record_hash_ignores_column_order_and_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, "a")], "b int, a string")
    one, two = conversion.record_hash(["a", "b"]), conversion.record_hash(["b", "a"])
    hashes = df.select(one.alias("x"), two.alias("y")).collect()
    assert all(r["x"] == r["y"] for r in hashes) and len({r["x"] for r in hashes}) == 3


def suggest(spark, *fields):
    rows = [("f", "Sales Fact", i, n, t, "", d, s) for i, (n, t, d, s) in enumerate(fields)]
    frame = spark.createDataFrame(rows, "file_name string, table_name string, position int, field_name string, tags array<string>, number_type string, number_decimals string, no_of_symbols string")
    return {r["source_column"] + str(r["position"]): r for r in conversion.suggest_mapping(frame).collect()}


def test_suggested_mapping(spark):
    got = suggest(
        spark, ("%CustKey", [], None, None), ("Order", ["$text"], None, None), ("order", ["$text"], None, None), ("Units", ["$numeric"], None, None),
        ("NetSales", ["$numeric"], None, None), ("Score", ["$numeric"], None, None), ("Score", ["$numeric"], "0", None), ("IsActive", [], None, "2"), ("IsActive", [], None, "9"), ("Blob", [], None, None),
    )
    kinds = {k: (r["target_type"], r["review_status"]) for k, r in got.items()}
    assert kinds["%CustKey0"] == ("STRING", "AUTO_APPROVED") and got["%CustKey0"]["target_column"] == "cust_key"
    assert got["Order1"]["target_column"] == "order_col" and got["order2"]["target_column"] == "order_col_1"
    assert kinds["Units3"] == ("BIGINT", "AUTO_APPROVED") and kinds["NetSales4"] == ("DECIMAL(18,2)", "AUTO_APPROVED")
    assert kinds["Score5"] == ("DOUBLE", "NEEDS_REVIEW") and kinds["Score6"] == ("BIGINT", "AUTO_APPROVED")
    assert kinds["IsActive7"] == ("BOOLEAN", "AUTO_APPROVED") and kinds["IsActive8"] == ("INT", "NEEDS_REVIEW")
    assert kinds["Blob9"] == ("STRING", "NEEDS_REVIEW") and got["Blob9"]["target_table"] == "sales_fact"


def test_mapping_errors(spark):
    rows = [("t", "a", "DATE", "AUTO_APPROVED"), ("T", "A", "date", "manually_approved"), ("t", "", "DATE", "AUTO_APPROVED"), ("t", "b", "GEOMETRY", "NEEDS_REVIEW"), ("t", "c", "INT", "maybe")]
    frame = spark.createDataFrame(rows, "target_table string, target_column string, target_type string, review_status string")
    got = sorted((r["target_column"], r["field"], r["error"].split(" ")[0]) for r in conversion.mapping_errors(frame).collect())
    assert [r["field"] for r in conversion.mapping_errors(frame.limit(0)).collect()] == ["mapping_rows"]
    assert got == [("", "target_column", "target_column"), ("a", "target_column", "Duplicate"), ("b", "review_status", "Row"), ("b", "target_type", "Unsupported"), ("c", "review_status", "Unsupported")]


@pytest.mark.parametrize("values,approved,detected,status", [
    (["1", "2", "3"], "BIGINT", "INTEGER", "MATCH"), (["1.25", "2.50", "3"], "DECIMAL(18,2)", "DECIMAL", "MATCH"), (["0", "1", "true", "N"], "BOOLEAN", "BOOLEAN_LIKE", "MATCH"),
    (["45292", "45293"], "DATE", "QLIK_DATE_SERIAL", "MATCH"), (["45292", "45293"], "BIGINT", "INTEGER", "MATCH"), (["10.5", "12.75"], "BIGINT", "DECIMAL", "MISMATCH"),
    (["A", "B"], "STRING", "STRING", "MATCH"), ([None, " "], "STRING", "STRING", "MATCH"), (["1", "x"], "INT", "STRING", "MISMATCH"), (["0", "1"], "INT", "BOOLEAN_LIKE", "NEEDS_REVIEW"),
    (["yes", "no"], "BOOLEAN", "STRING", "MISMATCH"), (["1e3", "2.0"], "", "INTEGER", "NEEDS_REVIEW"), (["45292", "90000"], "DATE", "INTEGER", "MISMATCH"),
])
def test_profile_types(spark, values, approved, detected, status):
    frame = spark.createDataFrame([(v,) for v in values], "`My Col` string")
    known = spark.createDataFrame([(" my col ", approved)], "source_column string, target_type string")
    row = profiling.profile(frame, known).first()
    assert (row["detected_runtime_type"], row["type_match_status"]) == (detected, status)


def test_profile_figures(spark):
    frame = spark.createDataFrame([("10",), ("9",), ("9",), (" 9",), ("",), (None,), ("x",), ("b",), ("c",), ("d",)], "v string")
    row = profiling.profile(frame).first()
    assert (row["row_count_checked"], row["null_count"], row["non_null_count"], row["distinct_count"]) == (10, 2, 8, 7)
    assert (row["min_value"], row["max_value"], row["sample_values"]) == ("9", "10", [" 9", "10", "9", "b", "c"])
    summary = profiling.profile_summary(profiling.profile(frame)).first()
    assert (summary["total_columns"], summary["needs_review_count"]) == (1, 1)
    words = profiling.profile(spark.createDataFrame([("pear",), ("apple",)], "v string")).first()
    assert (words["min_value"], words["max_value"]) == ("apple", "pear")


def test_native_types_profile_like_their_text(spark):
    frame = spark.createDataFrame(
        [(1, 2.5, Decimal("7.50"), date(2024, 3, 1), True, "a"), (0, -1.0, Decimal("7.00"), date(1999, 1, 2), False, "10"), (45000, 1e10, None, None, None, " "),
         (None, float("nan"), Decimal("-3.25"), date(2024, 3, 1), True, "9")],
        "i int, d double, n decimal(10,2), t date, b boolean, s string")
    texts = frame.select(*[F.col(c).cast("string").alias(c) for c in frame.columns])
    got, want = (sorted(profiling.profile(f).collect()) for f in (frame, texts))
    assert got == want
    facts = {r["column_name"]: r for r in profiling.column_facts(frame, exact=["i"]).collect()}
    assert (facts["i"]["distinct_count"], facts["d"]["distinct_count"]) == (3, None)
    assert {r["column_name"]: r["approx_distinct_count"] for r in profiling.quick_profile(frame).collect()} == {"i": 3, "d": 4, "n": 3, "t": 2, "b": 2, "s": 3}
    assert [r["detected_runtime_type"] for r in profiling.profile(frame.limit(0), exact=[]).collect()] == ["STRING"] * 6


def test_wide_profiles_take_several_passes(spark):
    wide = spark.range(5).select(*[(F.col("id") * i).alias(f"c.{i}") for i in range(70)])
    rows = {r["column_name"]: r for r in profiling.profile(wide).collect()}
    assert len(rows) == 70 and rows["c.69"]["max_value"] == "276" and rows["c.0"]["distinct_count"] == 1


def test_names_are_found_without_case(spark, tmp_path):
    spark.createDataFrame([("7", "2"), ("x", "3")], "CustKey string, QTY string").write.parquet(str(tmp_path / "in"))
    mapping = [{"source_column": s, "target_table": "t", "target_column": g, "target_type": "BIGINT", "conversion_rule": "cast_bigint"} for s, g in (("custkey", "CustKey"), ("Qty", "qty"))]
    seen = Observation("seen")
    rows, warnings = conversion.convert_table(spark.read.parquet(str(tmp_path / "in")), mapping, "b", "2024-01-01 00:00:00", seen)
    assert warnings == [] and sorted((r["CustKey"] or 0, r["qty"]) for r in rows.collect()) == [(0, 3), (7, 2)]
    assert seen.get == {"row_count": 2, "CustKey": 1, "qty": 0}
    report = {r["check_id"]: r["status"] for r in checks.output_checks(rows.withColumnRenamed("CustKey", "custKEY"), mapping, 2).collect()}
    assert report["approved_target_columns_exist"] == "passed" and report["numeric_values"] == "passed"
    spoiled = checks.output_checks(rows.withColumn("QTY", F.lit("many")), mapping, 2).collect()
    assert {r["check_id"]: r["status"] for r in spoiled}["numeric_values"] == "failed"


def verdicts(frame, rows=2):
    return {r["check_id"]: r["status"] for r in checks.output_checks(frame, MAPPING, rows).collect()}


def test_output_checks(source):
    good = conversion.convert_table(source.where("OrderDate IS NOT NULL"), MAPPING, "b", "2024-01-01 00:00:00")[0]
    assert set(verdicts(good).values()) == {"passed"} and set(verdicts(good, None).values()) == {"passed"}
    assert verdicts(good, 3)["row_count"] == "failed"
    fewer = verdicts(good.drop("amount"))
    assert (fewer["column_count"], fewer["approved_target_columns_exist"]) == ("failed", "failed")
    assert verdicts(good.drop("_batch_id"))["audit_columns_exist"] == "failed"
    assert verdicts(good.withColumn("order_date", F.lit(44197)))["date_conversion"] == "failed"
    assert verdicts(good.withColumn("is_active", F.lit("maybe")))["boolean_values"] == "failed"
    assert verdicts(good.withColumn("amount", F.lit("ten")))["numeric_values"] == "failed"
    report = checks.output_checks(good, MAPPING, 3)
    assert checks.overall_status(report).first()["overall_status"] == "failed"


def test_small_checks(spark):
    ten, three = spark.range(10), spark.range(3)
    parity = lambda n: checks.union_parity(ten, three, spark.range(n)).first()
    assert (parity(13)["status"], parity(12)["status"], parity(12)["difference"]) == ("passed", "failed", -1.0)
    assert checks.non_empty(spark.range(0), "x").first()["status"] == "failed"
    assert checks.load_status(ten, three).first()["status"] == "completed_with_warnings"
    nulls = checks.null_percentages(spark.createDataFrame([(1, None), (2, None), (3, 4)], "a int, b int"), ["a", "b"])
    assert {r["column_name"]: (r["null_percentage"], r["warning"]) for r in nulls.collect()} == {"a": (0.0, False), "b": (66.67, True)}
    empty = checks.null_percentages(spark.createDataFrame([], "a int"), ["a"]).first()
    assert empty["null_percentage"] == 0.0
    wide = spark.createDataFrame([(1, 2)], "id int, x int")
    named = lambda df: {r["check_id"]: (r["names"], r["status"]) for r in df.collect()}
    assert named(checks.field_parity(ten, wide, ["id"], wide)) == {
        "CONCATENATE_FIELD_PARITY_MISMATCH": ("x", "failed"), "CONCATENATE_SOURCE_ONLY_FIELD_LEAK": ("x", "failed")}
    assert named(checks.field_parity(ten, wide, ["ID"], ten))["CONCATENATE_FIELD_PARITY_MISMATCH"] == ("", "passed")
    missing = named(checks.join_key_issues(ten, three, "ID", "nope"))
    assert missing["JOIN_KEY_MISSING_RIGHT"] == ("nope", "failed") and "JOIN_KEY_UNMATCHED" not in missing
    found = checks.join_key_issues(ten, three, "ID", "id").where("check_id = 'JOIN_KEY_UNMATCHED'").first()
    assert (found["actual"], found["status"]) == (7.0, "failed")
    assert named(checks.join_key_issues(spark.createDataFrame([(1,)], "CustKey int"), spark.createDataFrame([("x",)], "CustomerName string"), "CustKey", "CustomerName"))[
        "JOIN_KEY_TO_TEXT"] == ("CustKey = CustomerName", "failed")
    kinds = checks.cardinality(ten.withColumn("k", F.lit(1)), "k", three, "id").first()
    assert (kinds["cardinality"], kinds["is_safe"]) == ("*:1", True)
    assert [r["is_grain"] for r in checks.grain_keys(ten, [["id"]]).collect()] == [True]
