"""Sorted access: previous value, row numbers, keep-latest, sort rules, top rows.

A plain window puts all rows of a key into one task. Here Spark's own range partitioner first deals the
rows out by the order, the window runs per (key, range), and one small summary row per (key, range) carries
the result across range borders. The answer is exact whatever the borders are; they only spread the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryload.session import cut_lineage

RANGE = "__range"


def _sort_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    return value.cast("double")


def range_borders(df: DataFrame, column: str, ranges: int) -> list[float]:
    """At most ``ranges - 1`` approximate quantiles of a sort column (a bounded list)."""
    steps = [i / ranges for i in range(1, ranges)]
    found = df.select(_sort_number(df, column).alias("x")).approxQuantile("x", steps, 0.5 / ranges)
    return sorted(set(found))


def range_number(column: str, borders: Sequence[float]) -> Column:
    """Number of borders at or below a double column, found by halving; NULL sorts first."""

    def halve(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN `{column}` >= {borders[middle]!r}D THEN {halve(middle + 1, high)} ELSE {halve(low, middle)} END"

    return F.expr(halve(0, len(borders)))


def _with_ranges(df: DataFrame, order: Sequence[str], ranges: int | None) -> DataFrame:
    """Rows with the number of their range of the whole order, NULL first; as many ranges as shuffle partitions.

    All columns of the order count, so rows of one date are still spread. The ranges are those of one shuffle, which two
    readers of the result have to share: it is written down before they read it.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.col(f"`{c}`").asc_nulls_first() for c in order])
    return cut_lineage(dealt.withColumn(RANGE, F.spark_partition_id()))


def _with_starts(cut: DataFrame, starts: DataFrame, real: str) -> DataFrame:
    """Rows plus one start row per (key, range), marked by ``real`` = 0 so that it sorts first."""
    return cut.withColumn(real, F.lit(1)).unionByName(
        starts.withColumn(real, F.lit(0)), allowMissingColumns=True
    )


def previous_value(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], output: str, ranges: int | None = None
) -> DataFrame:
    """``Previous(x)`` within ``keys``. ``order`` (of any types) must identify a row within its key.

    The last value before a range enters the window as a start row, so the rows are
    shuffled once and nothing is joined back to them.
    """
    cut = _with_ranges(df, order, ranges)
    last = cut.groupBy(*keys, RANGE).agg(
        F.max(F.struct(*order, F.col(f"`{value}`").alias("__value"))).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy(RANGE)
    starts = last.select(*keys, RANGE, F.lag("__last.__value").over(across).alias(value))
    inside = Window.partitionBy(*keys, RANGE).orderBy("__real", *order)
    rows = _with_starts(cut, starts, "__real").withColumn(output, F.lag(value).over(inside))
    return rows.where("__real = 1").select(*df.columns, output)


def peek(
    df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], offset: int, output: str, ranges: int | None = None
) -> DataFrame:
    """``Peek(x, -offset)``: the value ``offset`` rows back within ``keys``, found by row number."""
    numbered = row_numbers(df, keys, order, "__row", ranges)
    earlier = numbered.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
                              (F.col("__row") + offset).alias("__at"), F.col(f"`{value}`").alias(output))
    same = F.col("__row") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    return numbered.join(earlier, same, "left").select(*df.columns, output)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], output: str, ranges: int | None = None
) -> DataFrame:
    """``RowNo`` within ``keys``; with no keys it is ``RecNo`` over the whole table.

    A range starts with a row that counts for all rows before it; the number is a running sum.
    """
    cut = _with_ranges(df, order, ranges).withColumn("__step", F.lit(1).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, RANGE).agg(F.count("*").alias("__rows"))
    starts = counts.select(*keys, RANGE, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__step"))
    inside = (
        Window.partitionBy(*keys, RANGE).orderBy("__real", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = _with_starts(cut, starts, "__real").withColumn(output, F.sum("__step").over(inside))
    return rows.where("__real = 1").select(*df.columns, output)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``; one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def sort_by(df: DataFrame, rules: Sequence[tuple[str, str]], tie_break: Sequence[str] = ()) -> DataFrame:
    """O1, O2: sort rules as (column, ``asc``/``desc``) by priority.

    ``tie_break`` columns keep a frequent sort value from landing in one range partition.
    """
    order = [F.col(f"`{c}`").desc() if d.lower() == "desc" else F.col(f"`{c}`").asc() for c, d in rules]
    return df.orderBy(*order, *[F.col(f"`{c}`").asc() for c in tie_break])


def most_recent(df: DataFrame, newest: str, tie_break: Sequence[str], rows: int = 20) -> DataFrame:
    """O3: the newest ``rows`` rows (each task keeps only its own best rows)."""
    return df.orderBy(F.col(newest).desc(), *[F.col(c).desc() for c in tie_break]).limit(rows)


def preview(df: DataFrame, rows: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """The first ``rows`` rows."""
    if rows < 1:
        raise ValueError(f"Asked for {rows} rows; a preview has at least one.")
    return (df.orderBy(*order) if order else df).limit(rows)
