"""Plans: hot keys are split, filters reach the scan, nothing is broadcast or joined blindly."""

import pytest
from pyspark.sql import functions as F

from ferryload.operators import conversion, joins, ordering, profiling
from ferryload.plans import joining, loading
from ferryload.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def small_partitions(spark):
    """Thresholds low enough that a few megabytes count as skew, and no broadcast."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, rows, name):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    return spark.range(0, rows, 1, 32).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 512).alias(name))


def test_hot_right_side_is_split(spark, small_partitions):
    left = spark.range(0, 5003, 1, 8).select(F.col("id").alias("k"), F.lit("x").alias("a"))
    right = hot_rows(spark, 300_000, "b")
    joined = joins.natural_join(left, right, "left").select("k", "a", F.length("b").alias("b"))
    checked = joined.groupBy().agg(F.count("*").alias("n"), F.count("b").alias("m"))
    row = checked.collect()[0]
    assert (row["m"], row["n"]) == (300_000, 300_003)
    assert "SortMergeJoin(skew=true)" in plan(checked)


def test_hot_fact_key_is_split(spark, small_partitions):
    fact = hot_rows(spark, 300_000, "b")
    dimension = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    model, _ = joins.star_join(fact, {"d": (dimension, ["k"])})
    checked = model.groupBy().agg(F.count("d_name").alias("n"), F.max(F.length("b")).alias("l"))
    assert checked.collect()[0]["n"] == 300_000
    assert "SortMergeJoin(skew=true)" in plan(checked)


def test_ranges_spread_a_hot_key(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    cut = ordering._with_ranges(rows, ["at"], 64)
    largest = cut.groupBy("k", ordering.RANGE).count().agg(F.max("count")).first()[0]
    assert largest < 40_000 / 3 / 32
    same = ordering.row_numbers(rows, ["k"], ["at"], "n").where("k = 0").agg(F.max("n"), F.count_distinct("n")).first()
    assert tuple(same) == (13_334, 13_334)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(loading.load_project_filter(Tables(spark, FOLDER)))
    assert "GreaterThan(l_quantity,30.0)" in text and "l_comment" not in text
    flagship = plan(joining.month_region_sales(Tables(spark, FOLDER)))
    assert "l_shipdate" not in flagship and "c_name" not in flagship and "CartesianProduct" not in flagship


def test_samples_are_limited_before_the_shuffle(spark):
    values = profiling.distinct_values(spark.range(100).select(F.col("id").cast("string").alias("c")), ["c"])
    assert plan(profiling.samples(values)).count("WindowGroupLimit") == 2


def test_a_profile_without_distinct_counts_moves_one_row_a_task(spark):
    frame = spark.range(100).select("id", F.col("id").cast("string").alias("c"), (F.col("id") / 3).alias("d"))
    text = plan(profiling.profile(frame, exact=[]))
    assert text.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in text and "Window" not in text


def test_conversion_is_one_projection(spark, tmp_path):
    spark.range(5).select(F.col("id").cast("string").alias("A")).write.parquet(str(tmp_path / "in"))
    mapping = [{"source_column": "A", "target_table": "t", "target_column": "a", "target_type": "BIGINT", "conversion_rule": "cast_bigint"}]
    rows, _ = conversion.convert_table(spark.read.parquet(str(tmp_path / "in")), mapping, "b", "2024-01-01 00:00:00")
    assert "Exchange" not in plan(rows) and rows.agg(F.sum("a")).first()[0] == 10


def test_normalised_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Order Date` int, `order.date` int, `%Key` int, Select int")
    assert conversion.normalised(df).columns == ["order_date", "order_date_1", "key", "select_col"]
