import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ferryload.functions import aggregates as A
from ferryload.functions import classes as K
from ferryload.functions import conditions as C
from ferryload.functions import dates as D
from ferryload.functions import numbers as N
from ferryload.functions import text as X
from ferryload.session import local_session

local_session(app="tests")  # columns need a session
x = F.col("x")


@pytest.mark.parametrize("day,months,expected", [
    ("2024-01-31", 1, "2024-02-29"), ("2024-02-29", 12, "2025-02-28"), ("2024-05-31", 0, "2024-05-31"),
    ("2024-05-31", 24, "2026-05-31"), ("2024-05-31", -1, "2024-04-30"), ("2024-05-31", -12, "2023-05-31"), ("2024-04-30", 1, "2024-05-30"),
])
def test_add_months_clips_to_month_end(one, day, months, expected):
    assert str(one(D.add_months(x.cast("date"), months), x=day)) == expected


@pytest.mark.parametrize("value,expected", [
    ("44197", "2021-01-01"), ("44197.99", "2021-01-01"), ("-1.5", "1899-12-29"), ("0", "1899-12-30"), ("abc", None), ("", None), (None, None),
])
def test_serial_date(one, value, expected):
    got = one(D.serial_to_date(x), x=value)
    assert (str(got) if got else None) == expected


@pytest.mark.parametrize("value,months,expected", [
    ("201305", 12, "201405"), ("201301", -1, "201212"), ("201313", 1, None), ("n/a", 1, None), (" 201305 ", 0, "201305"), (None, 1, None),
])
def test_yyyymm_shift(one, value, months, expected):
    assert one(D.shift_yyyymm(x, months), x=value) == expected


def test_date_texts(one):
    day = x.cast("date")
    assert one(D.format_date(day, "YYYYMM"), x="2013-05-09") == "201305"
    assert one(D.format_date(day, "YYYY-MM-DD"), x="2013-05-09") == "2013-05-09"
    assert one(D.month_name(day), x="2013-05-09") == "May"
    assert [one(D.month_name(day), x=f"2013-{m:02d}-01") for m in (1, 12)] == ["Jan", "Dec"]
    assert str(one(D.month_start(day), x="2013-05-09")) == "2013-05-01"
    assert one(D.month_region_key(F.lit("East"), day), x="2012-05-09") == "East_201305"
    assert one(D.month_region_key(F.lit(None).cast("string"), day), x="2012-05-09") is None
    assert str(one(D.make_date(F.lit(2013), F.lit(2), F.lit(28)), x="")) == "2013-02-28"
    assert one(D.make_date(F.lit(2013), F.lit(2), F.lit(30)), x="") is None
    assert one(D.to_timestamp(x), x="not a time") is None
    assert str(one(D.today("2013-05-31"), x="")) == "2013-05-31"
    assert one(D.now("2013-05-31 10:00:00"), x="") == dt.datetime(2013, 5, 31, 10)


@pytest.mark.parametrize("value,expected", [
    ("2", 2), ("2.0", 2), (" 7 ", 7), ("2.5", None), ("", None), ("x", None), ("9223372036854775807", 9223372036854775807), (None, None),
])
def test_whole_numbers(one, value, expected):
    assert one(N.to_bigint(x), x=value) == expected


def test_decimals_round_half_up(one):
    assert one(N.to_decimal_18_2(x), x="1.005") == Decimal("1.01")
    assert one(N.to_decimal_18_2(x), x="12.75") == Decimal("12.75")
    assert one(N.to_decimal_18_2(x), x="none") is None


@pytest.mark.parametrize("value,expected", [
    ("1", True), ("TRUE", True), (" Yes ", True), ("y", True), ("0", False), ("No", False), ("false", False), ("maybe", None), ("", None), (None, None),
])
def test_flags(one, value, expected):
    assert one(N.flag_to_boolean(x), x=value) is expected


def test_unknown_types_and_rules_stay_text(one):
    assert N.spark_type("LONG") == "bigint" and N.spark_type("GEOMETRY") == "string" and N.spark_type("decimal(18,2)") == "decimal(18,2)"
    assert one(N.convert(x, "no_such_rule", "DATE"), x="44197") == "44197"
    assert one(N.convert(x, "flag_to_boolean_or_int_review", "INT"), x="3") == 3
    assert one(N.num(x), x="12") == 12 and one(N.num(x), x="a") is None
    assert one(N.ratio(F.lit(1), F.lit(0)), x="") is None


def test_text_functions(one):
    assert one(X.ampersand(x, "_", F.lit(5)), x="a") == "a_5"
    assert one(X.ampersand(x, "_"), x=None) is None
    assert one(X.mid(x, 2, 3), x="abcdef") == "bcd" and one(X.mid(x, 3), x="abcdef") == "cdef"
    assert one(X.left(x, 2), x="abc") == "ab" and one(X.right(x, 2), x="abc") == "bc"
    assert one(X.index(x, "c"), x="abc") == 3 and one(X.index(x, "z"), x="abc") == 0
    assert one(X.match(x, "a", "b"), x="b") == 2 and one(X.match(x, "a"), x=None) == 0
    assert one(X.wild_match(x, "q*", "AB?"), x="abc") == 2
    assert one(X.wild_match(x, "50%*", "a_c"), x="50% off") == 1 and one(X.wild_match(x, "a_c"), x="abc") == 0
    assert one(X.is_empty(x), x="  ") is True and one(X.is_textual(x), x="1e3") is False and one(X.is_numeric(x), x=None) is False


@pytest.mark.parametrize("name,expected", [
    ("%CustomerKey", "customer_key"), ("Calendar.Date", "calendar_date"), ("HTTPServerName", "http_server_name"), ("Order Date", "order_date"),
    ("A/B\\C", "ab_c"), ("lf_s_x", "lfs_x"), ("2013 Sales", "col_2013_sales"), ("Date", "date_col"), ("", "unnamed"), ("%%%", "unnamed"), ("Preis €", "preis"),
])
def test_column_names(one, name, expected):
    assert one(X.column_name(x), x=name) == expected


def test_business_and_display_names(one):
    assert one(X.business_name(x), x="Calendar.Date") == "Calendar Date"
    assert one(X.business_name(x), x="%grossMargin_rate2b") == "Gross Margin Rate2B"
    assert one(X.business_name(x), x="") == "Unnamed"
    assert one(X.display_name(x), x="PYQty") == "Prior Year Quantity"
    assert one(X.display_name(x), x="LF_Budget_Mth") == "Latest Forecast Budget Month"
    assert one(X.display_name(x), x="ActualSales") == "Actual Sales"


@pytest.mark.parametrize("path,expected", [
    ("lib://Data/Facts/FactTable.qvd", "facttable"), ("[..\\data\\AR Summary-1.qvd] (qvd)", "arsummary1"), ("'Orders'", "orders"), ("", ""), (None, ""),
    ("{{ source('raw', 'Fact Table') }}", "facttable"), ("C:\\data\\x.y.csv", "xy"),
])
def test_source_identity(one, path, expected):
    assert one(X.source_identity(x), x=path) == expected


@pytest.mark.parametrize("name", ["AccountDesc", "CustomerName", "ProductCode"])
@pytest.mark.parametrize("op", [">", "<", ">=", "<=", "<>", "!="])
def test_text_columns_compared_with_numbers(spark, name, op):
    rows = spark.createDataFrame([("a",), ("",), (None,)], f"{name} string")
    assert [r[0] for r in rows.where(C.compare_with_number(name, op, 0)).collect()] == ["a"]
    assert rows.where(C.compare_with_number(name, "=", 0)).count() == 2
    numbers = spark.createDataFrame([("5.0",), ("x",), (None,)], f"{name} string")
    assert [r[0] for r in numbers.where(C.compare_with_number(name, "=", 5)).collect()] == ["5.0"]


@pytest.mark.parametrize("name", ["SalesAmount", "TotalCost", "Quantity", "Budget"])
def test_number_columns_compare_as_they_are(spark, name):
    rows = spark.createDataFrame([(1.0,), (0.0,), (None,)], f"{name} double")
    assert rows.where(C.compare_with_number(name, ">", 0)).count() == 1
    assert rows.where(C.compare_with_number(name, "=", 0)).count() == 1


def test_history_flag(one):
    flag = C.history_flag(x.cast("date"), "2013-05-31")
    assert [one(flag, x=d) for d in ("2013-05-01", "2013-06-01", "2012-01-01")] == [1, 0, 1]


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 30.0), ("b", None, 5.0), ("b", 2, 7.0), ("b", 3, None)], "g string, k int, v double")
    got = {r["g"]: r for r in rows.groupBy("g").agg(
        A.only(F.col("k")).alias("only"), A.set_sum(F.col("v"), {"k": [1, 2]}).alias("chosen"), A.sum_if(F.col("k") == 2, F.col("v")).alias("if2"),
        A.first_sorted_value(F.col("v"), F.col("k")).alias("first"), A.last_sorted_value(F.col("k"), F.col("v")).alias("last"), A.sum_known(F.col("v")).alias("known"),
    ).collect()}
    assert (got["a"]["only"], got["b"]["only"]) == (1, None)
    assert (got["a"]["chosen"], got["b"]["chosen"]) == (40.0, 7.0)
    assert (got["a"]["if2"], got["b"]["if2"]) == (0.0, 7.0)
    assert (got["a"]["first"], got["b"]["first"], got["b"]["last"]) == (10.0, 7.0, 2)
    assert got["b"]["known"] == 12.0


@pytest.mark.parametrize("name,tags,number,expected", [
    ("OrderDate", [], "", "DATE_LIKE"), ("x", ["$Timestamp"], "", "DATE_LIKE"), ("CustomerID", ["$numeric"], "", "KEY_LIKE"), ("City", ["$text"], "", "TEXT_LIKE"),
    ("IsActive", [], "", "FLAG_LIKE"), ("Amount", [], "real", "NUMERIC_LIKE"), ("Amount", ["$numeric"], "", "NUMERIC_LIKE"), ("Amount", None, None, "UNKNOWN"),
])
def test_field_category(spark, name, tags, number, expected):
    rows = spark.createDataFrame([(name, tags, number)], "n string, t array<string>, f string")
    assert rows.select(K.field_category(F.col("n"), F.col("t"), F.col("f"))).first()[0] == expected


@pytest.mark.parametrize("expression,expected", [
    ("Sum({<Year={2025}>} Sales)", "set_analysis"), ("If(a=1, Sum(b), 0)", "conditional"), ("RGB(1,2,3)", "color"), ("sum(x)", "aggregation"), ("a & b", "expression"), (None, "expression"),
])
def test_expression_class(one, expression, expected):
    assert one(K.expression_class(x), x=expression) == expected


def test_aggregate_name(one):
    assert one(K.aggregate_name(x), x="1 + Sum(Sales)") == "SUM"
    assert one(K.aggregate_name(x), x="Summary") is None
