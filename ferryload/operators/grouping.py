"""Grouped jobs (S2/A1, A3, A4, A9, A12) for aggregates whose state grows with the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryload.operators.ordering import range_borders, range_number


def group_by(df: DataFrame, keys: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """A1: GROUP BY with named aggregates (combined before the shuffle by Spark)."""
    return df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])


def nested(
    df: DataFrame, inner_keys: Sequence[str], inner: dict[str, Column],
    outer_keys: Sequence[str], outer: dict[str, Column],
) -> DataFrame:
    """``Aggr``: aggregate per ``inner_keys``, then aggregate those results per ``outer_keys``."""
    return group_by(group_by(df, inner_keys, **inner), outer_keys, **outer)


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """Distinct count per group in two steps, so no task holds a group's whole set of values."""
    pairs = df.groupBy(*keys, value).agg(F.lit(1).alias("__one"))
    return pairs.groupBy(*keys).agg(F.count(F.col(f"`{value}`")).alias(output))


def mode(df: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """A3: most frequent known value per group; equal counts take the smallest value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    known = F.when(F.col(f"`{value}`").isNotNull(), F.struct(-F.col("__n"), F.col(f"`{value}`").alias("v")))
    best = counts.groupBy(*keys).agg(F.min(known).alias("__b"))  # a group of NULLs only has no mode, but stays
    return best.select(*keys, F.col("__b.v").alias(output))


def median(df: DataFrame, keys: Sequence[str], value: str, output: str, ranges: int = 256) -> DataFrame:
    """A3: exact median per group without sorting a group in one task.

    Quantiles of the whole column cut the values into ranges, so a range holds a bounded
    share of all rows whichever group they belong to. Counts per (group, range) say where
    the middle ranks are, and only the rows of those ranges are shuffled and sorted. A group of NULLs only has a NULL median.
    """
    x = F.col(f"`{value}`").cast("double")
    known = df.where(F.col(f"`{value}`").isNotNull()).select(*keys, x.alias("__x"))
    cut = known.withColumn("__range", range_number("__x", range_borders(df, value, ranges)))
    per_range = cut.groupBy(*keys, "__range").agg(F.count("*").alias("__rows"))  # combined before the shuffle
    group = Window.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__rows").over(group)
    placed = per_range.select(
        *keys, "__range", "__rows", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.floor((total + 1) / 2).alias("__low"), F.ceil((total + 1) / 2).alias("__high"),
    )

    def holds(rank: str, start: str, rows: str) -> Column:
        return (F.col(start) < F.col(rank)) & (F.col(rank) <= F.col(start) + F.col(rows))

    middle = placed.where(holds("__low", "__before", "__rows") | holds("__high", "__before", "__rows")).drop("__rows")
    candidates = _join_groups(cut, middle, [*keys, "__range"]).groupBy(
        *keys, "__range", "__before", "__low", "__high", "__x").agg(F.count("*").alias("__n"))
    running = Window.partitionBy(*keys, "__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = candidates.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__n").over(running), F.lit(0)))
    low, high = (F.max(F.when(holds(rank, "__start", "__n"), F.col("__x"))) for rank in ("__low", "__high"))
    medians = ranked.groupBy(*keys).agg(((low + high) / 2).alias(output))
    none = df.groupBy(*keys).agg(F.count(F.col(f"`{value}`")).alias("__n")).where("__n = 0")
    return medians.unionByName(none.select(*keys, F.lit(None).cast("double").alias(output)))


def concat_distinct(
    df: DataFrame, keys: Sequence[str], value: str, output: str, separator: str = ","
) -> DataFrame:
    """A4: sorted distinct values of a group as one text.

    Repeats are removed before the values meet, so the cell holds each value once.
    """
    values = df.select(*keys, F.col(f"`{value}`").cast("string").alias("__v"))
    joined = F.array_join(F.array_sort(F.collect_list("__v")), separator)
    return values.distinct().groupBy(*keys).agg(F.when(F.count("__v") > 0, joined).alias(output))


def concat(
    df: DataFrame, keys: Sequence[str], value: str, output: str, separator: str = ",", weight: str | None = None
) -> DataFrame:
    """A4: all values of a group as one text, repeats too, by ``weight`` and then by value; NULL for NULLs only.

    Equal values meet as one row with their number. The cell itself holds the group's values: that is what is asked for.
    """
    by = [F.col(f"`{weight}`")] if weight else []
    counts = df.groupBy(*keys, *[b.alias("__w") for b in by], F.col(f"`{value}`").cast("string").alias("__v")).agg(F.count("*").alias("__n"))
    rows = F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct(*(["__w"] if weight else []), "__v", "__n"))))
    texts = F.flatten(F.transform(rows, lambda r: F.array_repeat(r["__v"], r["__n"].cast("int"))))
    return counts.groupBy(*keys).agg(F.when(F.count("__v") > 0, F.array_join(texts, separator)).alias(output))


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on group columns where NULL is a group like any other."""
    if not keys:
        raise ValueError("Give at least one group column.")
    renamed = right.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    same = None
    for k in keys:
        test = F.col(f"`{k}`").eqNullSafe(F.col(f"`__g_{k}`"))
        same = test if same is None else same & test
    return left.join(renamed, same, "inner").drop(*[f"__g_{k}" for k in keys])
