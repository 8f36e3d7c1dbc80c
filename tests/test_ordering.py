"""Ordered operators against brute force, with one key that holds most rows."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferryload.operators import grouping as G
from ferryload.operators import ordering as O


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(7)
    out = []
    for i in range(3000):
        key = None if i % 50 == 0 else "hot" if pick.random() < 0.6 else f"k{pick.randrange(30)}"
        at = None if i % 97 == 0 else float(pick.randrange(400))
        out.append((key, at, i, pick.choice([None, 1.5, 2.5, 3.5, float(pick.randrange(1000))])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, at double, id int, v double").repartition(7)


def ordered(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return {k: sorted(g, key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for k, g in groups.items()}


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_previous_value(frame, rows, ranges):
    expected = {}
    for group in ordered(rows).values():
        for before, row in zip([None, *group], group):
            expected[row[2]] = before[3] if before else None
    got = O.previous_value(frame, "v", ["k"], ["at", "id"], "p", ranges)
    assert {r["id"]: r["p"] for r in got.collect()} == expected
    assert got.columns == ["k", "at", "id", "v", "p"]


@pytest.mark.parametrize("keys", [["k"], []])
def test_row_numbers(frame, rows, keys):
    groups = ordered(rows) if keys else ordered([(0, *r[1:]) for r in rows])
    expected = {row[2]: n for group in groups.values() for n, row in enumerate(group, 1)}
    assert {r["id"]: r["n"] for r in O.row_numbers(frame, keys, ["at", "id"], "n", 16).collect()} == expected


def test_latest_and_first(frame, rows):
    latest = {k: g[-1][2] for k, g in ordered(rows).items()}
    first = {k: g[0][2] for k, g in ordered(rows).items()}
    assert {r["k"]: r["id"] for r in O.keep_latest(frame, ["k"], ["at", "id"]).collect()} == latest
    assert {r["k"]: r["id"] for r in O.keep_first(frame, ["k"], ["at", "id"]).collect()} == first


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_median_is_exact(frame, rows, ranges):
    expected = defaultdict(list)
    for row in rows:
        if row[3] is not None:
            expected[row[0]].append(row[3])
    got = {r["k"]: r["m"] for r in G.median(frame, ["k"], "v", "m", ranges).collect()}
    assert got == {k: statistics.median(vs) for k, vs in expected.items()}


def test_mode_concat_and_distinct(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z"), ("b", "w"), ("b", None)], "g string, v string")
    df = df.unionByName(spark.createDataFrame([("n", None)], "g string, v string"))
    assert {r["g"]: r["m"] for r in G.mode(df, ["g"], "v", "m").collect()} == {"a": "y", "b": "w", "n": None}
    assert {r["g"]: r["c"] for r in G.concat_distinct(df, ["g"], "v", "c", "-").collect()} == {"a": "x-y", "b": "w-z", "n": None}
    assert {r["g"]: r["c"] for r in G.concat(df, ["g"], "v", "c", "-").collect()} == {"a": "x-y-y", "b": "w-z", "n": None}
    by = df.withColumn("w", F.when(F.col("v") == "y", 1).otherwise(2))
    assert {r["g"]: r["c"] for r in G.concat(by, ["g"], "v", "c", "-", "w").collect()} == {"a": "y-y-x", "b": "w-z", "n": None}
    numbers = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("n", None)], "g string, x double")
    assert {r["g"]: r["m"] for r in G.median(numbers, ["g"], "x", "m").collect()} == {"a": 2.5, "n": None}
    df = df.where("g <> 'n'")
    assert {r["g"]: r["n"] for r in G.distinct_count(df, ["g"], "v", "n").collect()} == {"a": 2, "b": 2}


def test_sort_rules_and_preview(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "n int, s string")
    assert [r["n"] for r in O.sort_by(df, [("s", "asc"), ("n", "desc")]).collect()] == [3, 2, 1]
    assert O.preview(df, 2, ["n"]).count() == 2 and O.preview(spark.range(20_001), 20_000).count() == 20_000
    with pytest.raises(ValueError):
        O.preview(df, 0)
    assert [r["n"] for r in O.most_recent(df, "n", ["s"], 2).collect()] == [3, 2]


def test_range_number(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (4.9,), (5.0,), (99.0,)], "x double")
    assert [r[0] for r in df.select(O.range_number("x", [1.0, 5.0, 9.0])).collect()] == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,4)", "timestamp", "int"])
def test_row_access_over_any_order(spark, kind):
    """One key on one value of the first order column: the second column spreads it over ranges."""
    texts = {"string": "x", "date": "2024-01-02", "decimal(20,4)": "1.5", "timestamp": "2024-01-02 03:04:05", "int": "7"}
    df = spark.range(500).select(F.lit("k").alias("k"), F.when(F.col("id") % 50 == 0, None).otherwise(F.lit(texts[kind])).cast(kind).alias("o"), (499 - F.col("id")).alias("n"))
    want = [r["n"] for r in df.orderBy("o", "n").collect()]
    before = {r["n"]: r["p"] for r in O.previous_value(df, "n", ["k"], ["o", "n"], "p", 16).collect()}
    assert before == dict(zip(want, [None, *want]))
    assert {r["n"]: r["p"] for r in O.peek(df, "n", ["k"], ["o", "n"], 3, "p", 16).collect()} == dict(zip(want, [None] * 3 + want))
    assert {r["n"]: r["p"] for r in O.row_numbers(df, [], ["o", "n"], "p", 16).collect()} == {n: i + 1 for i, n in enumerate(want)}
    assert O._with_ranges(df, ["o", "n"], 16).select(O.RANGE).distinct().count() > 8
