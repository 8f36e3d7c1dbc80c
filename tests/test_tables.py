"""Sources, sinks, unions and joins on small fixtures."""

import io
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ferryload.operators import combine, joins
from ferryload.session import shared_folder
from ferryload.sources import headers, sinks
from ferryload.sources import tables as S

FACT = "MonthlyRegionKey string, Region string, CustKey int, YYYYMM string"
EXPENSES = "MonthlyRegionKey string, Region string, YYYYMM string, Account string, ExpenseActual double, ExpenseBudget double"


def test_inline_table(spark):
    text = "Code, Name, \n// a comment line\n 1, One\n2\n\n3, 'x', extra\n"
    rows = S.inline_table(spark, text)
    assert rows.columns == ["Code", "Name"]
    assert [tuple(r) for r in rows.collect()] == [("1", "One"), ("2", ""), ("3", "'x'")]


def test_inline_table_keeps_all_rows(spark):
    text = "n\n" + "\n".join(str(i) for i in range(6001))
    assert S.inline_table(spark, text).count() == 6001


def test_load_groups_filters_and_orders(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", None)], "A string, B int")
    final = S.load(df, where=[F.col("B") > 0, F.col("A") != "b"], group=["A"], aggregates=[F.sum("B").alias("s")])
    assert [tuple(r) for r in final.collect()] == [("a", 3)]
    assert S.load(df, fields=["A"], distinct=True, order=["A"]).count() == 3


def test_concatenate_target_schema(spark):
    fact = spark.createDataFrame([("k1", "East", 7, "201301")], FACT)
    expenses = spark.createDataFrame([("k2", "West", "201302", "4711", 5.0, 6.0)], EXPENSES)
    both = combine.concatenate_into(fact, expenses, ["MonthlyRegionKey", "Region", "YYYYMM"])
    assert both.columns == fact.columns
    assert sorted(tuple(r) for r in both.collect()) == [("k1", "East", 7, "201301"), ("k2", "West", None, "201302")]
    unlisted = combine.concatenate_into(fact, expenses, ["MonthlyRegionKey"]).where("MonthlyRegionKey = 'k2'").first()
    assert unlisted["Region"] is None


def test_concatenate_widens_with_typed_nulls(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "A int, B string, C double")
    b = spark.createDataFrame([(9,)], "A int")
    wide = combine.concatenate(a, b, spark.createDataFrame([(True,)], "D boolean"))
    assert dict(wide.dtypes) == {"A": "int", "B": "string", "C": "double", "D": "boolean"}
    assert wide.where("A = 9").first()["B"] is None
    with pytest.raises(ValueError):
        combine.append(a, b)


def test_drop_fields_keeps_earlier_unions(spark):
    a = spark.createDataFrame([(1, "x")], "A int, B string")
    union = combine.concatenate(a, a)
    assert combine.drop_fields(a, "B").columns == ["A"] and union.columns == ["A", "B"]
    assert S.drop_table({"T": a, "Keep": a}, "[t]").keys() == {"Keep"}


def test_natural_join_kinds(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "CustID int, CustName string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "q")], "CustID int, CustAddress string")
    shape = lambda how, **kw: sorted((r["CustID"] or 0, r["CustName"] or "", r["CustAddress"] or "") for r in joins.natural_join(left, right, how, **kw).collect())
    for how in ("left", "inner", "right", "full"):
        plain = sorted((r["CustID"] or 0, r["CustName"] or "", r["CustAddress"] or "") for r in left.join(right, ["CustID"], how).collect())
        assert shape(how) == plain
    assert shape("outer") == shape("full")
    with pytest.raises(ValueError):
        joins.natural_join(left, right.withColumnRenamed("CustID", "other"))


def test_single_row_tables_attach(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert [tuple(r) for r in joins.attach_single_row(df, spark.createDataFrame([("v", None)], "p string, q int")).collect()] == [(1, "v", None), (2, "v", None)]
    with pytest.raises(ValueError):
        joins.attach_single_row(df, spark.createDataFrame([(1,), (2,)], "p int"))


def test_keep_and_maps(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2, "x"), (2, "y"), (4, "z")], "k int, v string")
    left, right = joins.keep(a, b, "inner")
    assert (left.count(), right.count()) == (2, 2)
    assert joins.keep(a, b, "left")[1].count() == 3
    rows = spark.createDataFrame([("k", "second", 2), ("k", "first", 1), ("n", None, 1)], "key string, value string, o int")
    mapped = joins.apply_map(spark.createDataFrame([("k",), ("n",), ("q",), (None,)], "c string"), joins.mapping(rows, "key", "value", "o"), "c", "m")
    assert {r["c"]: r["m"] for r in mapped.collect()} == {"k": "first", "n": None, "q": "q", None: None}


def test_star_join_reaches_over_bridges(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, branch int")
    bridge = spark.createDataFrame([(10, "s1"), (20, "s9")], "branch int, short string")
    item = spark.createDataFrame([("s1", "Item 1")], "short string, name string")
    lonely = spark.createDataFrame([("z",)], "zone string")
    model, left_out = joins.star_join(fact, {"im": (item, ["short"]), "ibm": (bridge, ["branch"]), "zz": (lonely, ["zone"])})
    assert left_out == ["zz"] and set(model.columns) == {"id", "branch", "short", "im_name"}
    assert {r["id"]: r["im_name"] for r in model.collect()} == {1: "Item 1", 2: None, 3: None}
    with pytest.raises(ValueError):
        joins.grain_join(fact, fact, ["id"])


def test_full_join_on_grain_matches_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    got = {(r["k"], r["a"], r["b"]) for r in joins.full_on_grain(a, b, ["k"]).collect()}
    assert got == {(None, 1, 3), ("x", 2, None), ("y", None, 4)}


def test_star_join_leaves_out_tables_that_multiply_rows(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20)], "id int, branch int")
    bucketed = spark.createDataFrame([(10, "a"), (10, "b")], "branch int, bucket string")
    clean = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    model, left_out = joins.star_join(fact, {"ar": (bucketed, ["branch"]), "n": (clean, ["id"])}, verify=True)
    assert left_out == ["ar"] and sorted(tuple(r) for r in model.select("id", "n_name").collect()) == [(1, "x"), (2, "y")]


def test_enrichment_and_projection(spark):
    fact = spark.createDataFrame([(1, 2)], "k int, city int")
    dimension = spark.createDataFrame([(1, "c", "s")], "k int, City string, State string")
    assert dimension.select("k", *combine.enrichment(fact, dimension, "adr", ["k"])).columns == ["k", "adr_state"]
    named = combine.project(spark.createDataFrame([(1, 2)], "`A b` int, c int"), {"X": "[A b]", "Y Z": F.col("c") + 1})
    assert tuple(named.first()) == (1, 3) and named.columns == ["X", "Y Z"]


HEADER = (
    '<QvdTableHeader><TableName>SalesFact</TableName><NoOfRecords>42</NoOfRecords><CreatorDoc>app</CreatorDoc><Fields>'
    '<QvdFieldHeader><FieldName>OrderDate</FieldName><BitOffset>0</BitOffset><BitWidth>8</BitWidth><NumberFormat><Type>DATE</Type><Fmt>YYYY</Fmt></NumberFormat>'
    '<NoOfSymbols>7</NoOfSymbols><Tags><String>$date</String><String>$numeric</String></Tags></QvdFieldHeader>'
    '<QvdFieldHeader><FieldName>Größe &amp; ID</FieldName><Tags><String>$text</String></Tags></QvdFieldHeader>'
    '<QvdFieldHeader><FieldName>IsActive</FieldName><NoOfSymbols>2</NoOfSymbols></QvdFieldHeader></Fields></QvdTableHeader>'
)


@pytest.mark.parametrize("reader", ["read_extract_files", "read_extract_heads"])
def test_extract_headers(spark, tmp_path, reader):
    (tmp_path / "sales.qvd").write_bytes(b"\x00\x00" + HEADER.encode() + b"\x00\xff\xfe<QvdTableHeader>" + bytes(range(256)) * 2000)
    (tmp_path / "broken.qvd").write_bytes(b"no header here")
    files = getattr(headers, reader)(spark, str(tmp_path))
    fields = {r["field_name"]: r for r in headers.header_fields(files).collect()}
    assert list(fields) and set(fields) == {"OrderDate", "Größe & ID", "IsActive"}
    date = fields["OrderDate"]
    assert (date["table_name"], date["no_of_records"], date["position"], date["tags"], date["number_type"], date["bit_width"]) == ("SalesFact", "42", 1, ["$date", "$numeric"], "DATE", "8")
    classes = {r["field_name"]: r["inferred_category"] for r in headers.source_structure(files).collect()}
    assert classes == {"OrderDate": "DATE_LIKE", "Größe & ID": "KEY_LIKE", "IsActive": "FLAG_LIKE"}
    tables = {r["file_name"]: r for r in headers.header_tables(files).collect()}
    assert tables["broken.qvd"]["has_header"] is False and tables["broken.qvd"]["field_count"] == 0
    assert tables["sales.qvd"]["field_count"] == 3


def test_headers_are_read_within_bounds(monkeypatch):
    monkeypatch.setattr(headers, "SCAN_BYTES", 300_000)
    monkeypatch.setattr(headers, "_CHUNK_BYTES", 1000)
    text = headers.HEADER_START.encode() + b"x" * 5000 + headers.HEADER_END.encode()

    class Endless(io.RawIOBase):
        read_bytes = 0

        def read(self, n=-1):
            self.read_bytes += n
            return b"\x00" * n

    endless = Endless()
    assert headers._head_of(endless) is None and endless.read_bytes == 300_000
    for before in (0, 1, 990, 999, 1000, 5555):
        assert headers._head_of(io.BytesIO(b"\x00" * before + text + b"y" * 9000)) == text
    assert headers._head_of(io.BytesIO(text[:-1])) is None and headers._head_of(io.BytesIO(b"")) is None


def test_stable_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "b int, A int, c int, `a.x` int")
    assert combine.stable_columns(df).columns == ["A", "a.x", "b", "c"]
    assert combine.stable_columns(df, ["C", "nope"]).columns == ["c", "A", "a.x", "b"]
    assert list(combine.stable_tables({"z": df, "B": df, "a": df})) == ["a", "B", "z"]


def test_a_cluster_has_to_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default if key == "spark.checkpoint.dir" else "/warehouse"

    def session_on(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=Conf(), sparkContext=context)

    assert shared_folder(session_on("local[4]")) == "/warehouse/_checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_on("spark://host:7077"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b1"), (2, "b", "b2")], "id int, name string, _batch_id string")
    path = sinks.write_typed(df, str(tmp_path), "t/x")
    sinks.write_typed(df, str(tmp_path), "t/x")
    assert os.path.basename(path) == "t_x" and spark.read.parquet(path).count() == 2  # the same batches again
    assert {d for d in os.listdir(path) if d.startswith("_batch")} == {"_batch_id=b1", "_batch_id=b2"}
    listed = S.part_files(spark.read.parquet(path))
    assert listed.count() == 2 and listed.where("file_size > 0").count() == 2 and "Scan parquet" not in listed._jdf.queryExecution().toString()
    sinks.store(df, str(tmp_path / "out.csv"))
    assert S.read_table(spark, str(tmp_path / "out.csv"), "csv", "id int, name string, b string", header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.store(df, str(tmp_path / "out.xlsx"))
    S.file_view(spark, path, "landed")
    assert S.sql_source(spark, "SELECT count(*) AS n FROM landed WHERE id = :i", {"i": 1}).first()["n"] == 1


def test_table_loads(spark, tmp_path):
    mapping = [{"target_column": "id", "target_type": "BIGINT"}, {"target_column": "amount", "target_type": "DECIMAL(18,2)"}]
    spark.createDataFrame([("1", "2.5"), ("x", "3")], "id string, amount string").write.parquet(str(tmp_path / "in"))
    location = tmp_path / "warehouse"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS loads LOCATION '{location}'")
    sinks.create_table(spark, "loads.target", mapping)
    sinks.typed_load(spark, str(tmp_path / "in"), "loads.target", mapping)
    rows = {r["id"]: r for r in spark.table("loads.target").collect()}
    assert set(rows) == {1, None} and str(rows[1]["amount"]) == "2.50"
    assert rows[1]["_source_file_name"].endswith(".parquet") and rows[1]["_ingestion_timestamp"] is not None and rows[1]["_record_hash"] is None
    sinks.raw_load(spark.table("loads.target").select("id"), "loads.raw")
    assert spark.table("loads.raw").count() == 2

    def batch(name, *ids):
        return spark.createDataFrame([(str(i), "1", name) for i in ids], "id string, amount string, _batch_id string")

    def ids(table):
        return sorted((r["_batch_id"], int(r["id"])) for r in spark.table(table).where("_batch_id IS NOT NULL").collect())

    landed = str(tmp_path / "landed")
    for rows in (batch("007", 1, 2), batch("b8", 3), batch("007", 4)):
        sinks.typed_load(spark, sinks.write_typed(rows, landed, "t"), "loads.target", mapping)
    assert ids("loads.target") == [("007", 4), ("b8", 3)]
    spark.sql("CREATE TABLE loads.foreign (id BIGINT, amount DECIMAL(18,2), _batch_id STRING, _source_file_name STRING, _source_file_path STRING,"
              " _ingestion_timestamp TIMESTAMP, _record_hash STRING) USING parquet")
    for _ in range(2):
        sinks.typed_load(spark, f"{landed}/t", "loads.foreign", mapping)
    assert ids("loads.foreign") == [("007", 4), ("b8", 3)]
    for rows in (batch("007", 1, 2), batch("b8", 3), batch("007", 4)):
        sinks.raw_load(rows, "loads.batches")
    assert ids("loads.batches") == [("007", 4), ("b8", 3)]
    spark.sql("DROP DATABASE loads CASCADE")


def test_names_are_compared_without_case(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "CustKey int, r string")
    right = spark.createDataFrame([(2, "a"), (1, "a")], "custkey int, R string")
    joined = joins.natural_join(left, right, "left")
    assert joined.columns == ["CustKey", "r"] and joined.count() == 2
    assert joins.keep(left, right, "left")[0].collect() == [(1, "a")]
    with pytest.raises(ValueError, match="KEEP"):
        joins.keep(left, spark.createDataFrame([(1,)], "other int"))


def test_star_join_loses_no_column_and_reaches_a_dimension_twice(spark):
    fact = spark.createDataFrame([(1, 5)], "custkey int, suppkey int")
    cust, supp = spark.createDataFrame([(1, 10)], "custkey int, nationkey int"), spark.createDataFrame([(5, 20)], "SuppKey int, nationkey int")
    nation = spark.createDataFrame([(10, "x"), (20, "y")], "nationkey int, name string")
    model, left_out = joins.star_join(fact, {
        "cust": (cust, ["custkey"]), "supp": (supp, ["suppkey"]), "buyer": (nation, {"cust.nationkey": "nationkey"}), "seller": (nation, {"supp.nationkey": "nationkey"}),
        "gone": (nation, {"cust.zone": "nationkey"})})
    row = model.first().asDict()
    assert left_out == ["gone"] and (row["buyer_name"], row["seller_name"], row["cust_nationkey"], row["supp_nationkey"]) == ("x", "y", 10, 20)


def test_grain_and_bridge_joins_refuse_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="aggregate"):
        joins.grain_join(left, right, ["k"])
    with pytest.raises(ValueError, match="bridge"):
        joins.bridge_join(left, right, spark.createDataFrame([("a", 1)], "v string, x int"))


def test_batch_ids_survive_writing_and_reading(spark, tmp_path):
    df = spark.createDataFrame([(1, "007"), (2, "2024-01-01"), (3, "1e5")], "id int, _batch_id string")
    for row in df.collect():
        sinks.write_typed(df.where(F.col("id") == row["id"]), str(tmp_path), "t")
    assert {tuple(r) for r in sinks.read_written(spark, str(tmp_path / "t")).select("id", "_batch_id").collect()} == {(1, "007"), (2, "2024-01-01"), (3, "1e5")}
