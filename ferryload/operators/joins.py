"""Joins with load-script semantics.

Spark picks broadcast or sort-merge from table sizes, and adaptive execution splits
skewed partitions. What is left to this module is the shape of each join:

* the side that is looked up is reduced to one row per key first, so a join never
  multiplies rows by accident;
* an outer join against a side with many rows per key is built as matched plus
  unmatched rows, because only inner joins can be split on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_fields(left: DataFrame, right: DataFrame) -> list[str]:
    """The natural-join keys: all field names both tables have, whatever their case, as the left table spells them."""
    known = {c.lower() for c in right.columns}
    return sorted(c for c in left.columns if c.lower() in known)


def spelled_like(right: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table with the given names in the given spelling."""
    spelling = {c.lower(): c for c in reversed(names)}  # the first spelling counts
    return right.toDF(*[spelling.get(c.lower(), c) for c in right.columns])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", unique_right: bool = False) -> DataFrame:
    """Equi-join on all shared field names.

    ``unique_right`` promises one row per key on the right (a dimension); then a plain
    outer join is used, whose left side Spark can split. Otherwise outer joins are
    put together from an inner join and the unmatched rows.
    """
    keys = shared_fields(left, right)
    if not keys:
        raise ValueError("No shared field. Use attach_single_row for a one-row table.")
    right = spelled_like(right, keys)
    how = {"outer": "full", "full_outer": "full", "left_outer": "left", "right_outer": "right"}.get(how.lower(), how.lower())
    if how == "inner" or (how == "left" and unique_right):
        return left.join(right, keys, how)
    matched = left.join(right, keys, "inner")
    parts = [matched]
    if how in ("left", "full"):
        parts.append(left.join(distinct_keys(right, keys), keys, "left_anti"))
    if how in ("right", "full"):
        parts.append(right.join(distinct_keys(left, keys), keys, "left_anti"))
    if len(parts) == 1:
        raise ValueError(f"Unknown join type '{how}'.")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations of a table, each once (combined before the shuffle)."""
    return df.select(*[F.col(f"`{k}`") for k in keys]).distinct()


def attach_single_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """No shared field. Only a table proven to hold at most one row is attached, as constants."""
    rows = single.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("Tables without a shared field can be joined only if one of them has one row.")
    values = rows[0] if rows else [None] * len(single.columns)
    constants = [
        F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(values, single.schema.fields)
    ]
    return df.select("*", *constants)


def keep(left: DataFrame, right: DataFrame, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """KEEP: reduce tables to rows with matching keys; they stay two tables."""
    keys = shared_fields(left, right)
    if not keys:
        raise ValueError("No shared field: KEEP needs one to compare rows by.")
    kept_left = left.join(distinct_keys(spelled_like(right, keys), keys), keys, "left_semi") if how in ("left", "inner") else left
    kept_right = right.join(distinct_keys(left, keys), keys, "left_semi") if how in ("right", "inner") else right
    return kept_left, kept_right


def mapping(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """MAPPING LOAD: one row per key, the first by ``order`` (else the smallest value)."""
    first = F.min_by(F.col(value), F.struct(order or value, value))
    return df.groupBy(F.col(key).alias("__map_key")).agg(first.alias("__map_value"))


def apply_map(
    df: DataFrame, map_rows: DataFrame, key: str, output: str, default: Column | None = None
) -> DataFrame:
    """ApplyMap: mapped value, else ``default``, else the key itself. ``map_rows`` comes from :func:`mapping`."""
    found = F.when(F.col("__map_key").isNotNull(), F.col("__map_value"))
    fallback = F.col(f"`{key}`").cast("string") if default is None else default
    missing = F.col("__map_key").isNull()
    joined = df.join(map_rows, F.col(f"`{key}`") == F.col("__map_key"), "left")
    return joined.withColumn(output, F.when(missing, fallback).otherwise(found)).drop("__map_key", "__map_value")


def map_literal(key: Column, pairs: dict[str, str], default: Column | None = None) -> Column:
    """ApplyMap over a map written in the script itself."""
    entries = [F.lit(part) for pair in pairs.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), default if default is not None else key)


def exists_flag(df: DataFrame, key: str, other: DataFrame, other_key: str, output: str) -> DataFrame:
    """``Exists(field, x)`` as a column."""
    known = other.select(F.col(f"`{other_key}`").alias("__known")).where(F.col("__known").isNotNull()).distinct()
    joined = df.join(known, F.col(f"`{key}`") == F.col("__known"), "left")
    return joined.withColumn(output, F.col("__known").isNotNull()).drop("__known")


def star_join(
    fact: DataFrame, dimensions: dict[str, tuple[DataFrame, Sequence[str] | dict[str, str]]], verify: bool = False
) -> tuple[DataFrame, list[str]]:
    """Fact with every dimension that can be reached through joined tables.

    ``dimensions`` maps an alias to (table, key columns). Tables behind a bridge are joined
    to the bridge first, so the fact is joined only with its direct dimensions. New columns
    are named ``alias_column``; key columns keep their name, unless the fact side has a column of that name already:
    then they, too, are named ``alias_column``, and nothing is lost. Names are compared without case. A dimension that is
    reached twice is given twice, each time with key pairs ``{"parent.column": "column"}``. Dimensions whose keys never
    appear are left out and their aliases returned. Every dimension must have one row per
    key; with ``verify`` this is measured first, and tables that would multiply fact rows
    are left out as well.
    """
    paired = {a: (table, keys) for a, (table, keys) in dimensions.items() if isinstance(keys, dict)}
    names = list(dict.fromkeys([*fact.columns, *(k for _, keys in dimensions.values() if not isinstance(keys, dict) for k in keys)]))
    spelling = {c.lower(): c for c in reversed(names)}
    dimensions = {a: (spelled_like(table, names), [spelling[k.lower()] for k in keys]) for a, (table, keys) in dimensions.items() if a not in paired}
    unsafe = _repeated({**dimensions, **{a: (table, list(keys.values())) for a, (table, keys) in paired.items()}}) if verify else []
    dimensions = {alias: d for alias, d in dimensions.items() if alias not in unsafe}
    links = {k for _, keys in dimensions.values() for k in keys}
    shaped = {
        alias: table.select(*[
            F.col(f"`{c}`").alias(c if c in links else f"{alias}_{c}".lower()) for c in table.columns
        ])
        for alias, (table, _) in dimensions.items()
    }
    reached = [a for a, (_, keys) in dimensions.items() if set(keys) <= set(fact.columns)]
    host: dict[str, str] = {}
    for parent in reached:  # grows while tables behind reached ones are found
        for alias, (_, keys) in dimensions.items():
            if alias not in reached and set(keys) <= set(shaped[parent].columns):
                host[alias] = parent
                reached.append(alias)
    for alias in reversed(reached):
        if alias in host:
            shaped[host[alias]] = _look_up(shaped[host[alias]], shaped[alias], dimensions[alias][1], alias)
    result = fact
    for alias in reached:
        if alias not in host:
            result = _look_up(result, shaped[alias], dimensions[alias][1], alias)
    # Keys may also come from several joined tables together.
    waiting = [a for a in dimensions if a not in reached]
    ready = [a for a in waiting if set(dimensions[a][1]) <= set(result.columns)]
    while ready:
        for alias in ready:
            result = _look_up(result, shaped[alias], dimensions[alias][1], alias)
        waiting = [a for a in waiting if a not in ready]
        ready = [a for a in waiting if set(dimensions[a][1]) <= set(result.columns)]
    for alias, (table, pairs) in paired.items():
        if alias in unsafe:
            continue
        here = {c.lower(): c for c in result.columns}
        ends = {own: here.get(end.replace(".", "_").lower()) or here.get(end.split(".")[-1].lower()) for end, own in pairs.items()}
        if None in ends.values():
            waiting.append(alias)
            continue
        renamed = table.select(*[F.col(f"`{c}`").alias(f"{alias}_{c}".lower()) for c in table.columns])
        same = None
        for own, end in ends.items():
            test = result[f"`{end}`"] == renamed[f"`{alias}_{own}`".lower()]
            same = test if same is None else same & test
        result = result.join(renamed, same, "left")
    return result, sorted([*waiting, *unsafe])


def _repeated(dimensions: dict[str, tuple[DataFrame, Sequence[str]]]) -> list[str]:
    """Aliases of tables in which a key occurs more than once; one row per table reaches the driver."""
    most = None
    for alias, (table, keys) in dimensions.items():
        counts = table.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
        part = counts.agg(F.lit(alias).alias("alias"), F.max("n").alias("n"))
        most = part if most is None else most.unionByName(part)
    return [row["alias"] for row in most.where("n > 1").collect()] if most is not None else []


def _look_up(df: DataFrame, dimension: DataFrame, keys: Sequence[str], alias: str) -> DataFrame:
    """Left join with a table that has one row per key; a column that ``df`` has already is named after the table."""
    taken = {c.lower() for c in df.columns} - {k.lower() for k in keys}
    shaped = dimension.select(*[F.col(f"`{c}`").alias(f"{alias}_{c}".lower() if c.lower() in taken else c) for c in dimension.columns])
    return df.join(shaped, list(keys), "left")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise where a key occurs more than once, before a join multiplies rows by it."""
    most = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > 1:
        raise ValueError(f"{what} has up to {most} rows for one key of {list(keys)}; aggregate it first.")


def bridge_join(fact: DataFrame, bridge: DataFrame, dimension: DataFrame, check: bool = True) -> DataFrame:
    """Fact to dimension through a bridge; all three are joined on their shared fields. With ``check`` the keys of
    bridge and dimension are proven unique first, so that no fact row is multiplied."""
    if check:
        require_unique(bridge, [c for c in bridge.columns if c.lower() in {k.lower() for k in fact.columns}], "The bridge")
        beyond = {k.lower() for k in [*fact.columns, *bridge.columns]}
        require_unique(dimension, [c for c in dimension.columns if c.lower() in beyond], "The dimension")
    return natural_join(natural_join(fact, bridge, "left", unique_right=True), dimension, "left", unique_right=True)


def grain_join(left: DataFrame, right: DataFrame, grain: Sequence[str], how: str = "left", check: bool = True) -> DataFrame:
    """Join on the whole grain. Joining on part of it is refused, and with ``check`` so is a right side in which a
    grain key repeats."""
    left, right = spelled_like(left, grain), spelled_like(right, grain)
    missing = [k for k in grain if k not in left.columns or k not in right.columns]
    extra = [k for k in shared_fields(left, right) if k not in grain]
    if missing or extra:
        raise ValueError(f"Join must use the whole grain; missing {missing}, unlisted shared fields {extra}.")
    if check:
        require_unique(right, list(grain), "The right side")
    return left.join(right, list(grain), how)


def aggregate_then_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], **aggregates: Column
) -> DataFrame:
    """Bring the right side to the join grain first, then left join it."""
    per_key = right.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return left.join(per_key, list(keys), "left")


def pivot_then_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: str, buckets: Sequence[str], value: str
) -> DataFrame:
    """One column per bucket and one row per key, then left join it."""
    per_key = right.groupBy(*keys).agg(*[
        F.sum(F.when(F.col(bucket) == b, F.col(value))).alias(f"{value}_{b}") for b in buckets
    ])
    return left.join(per_key, list(keys), "left")


def side_by_side(**totals: DataFrame) -> DataFrame:
    """One-row frames next to each other, columns prefixed with their name; stacked, then folded."""
    renamed = [
        df.select(*[F.col(f"`{c}`").alias(f"{name}_{c}") for c in df.columns]) for name, df in totals.items()
    ]
    stacked = renamed[0]
    for part in renamed[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in stacked.columns])


def full_on_grain(left: DataFrame, right: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Full outer join of two results with one row per grain key; NULL keys match each other."""
    right_keys = {k: f"__right_{k}" for k in grain}
    renamed = right.withColumnsRenamed(right_keys)
    same = None
    for k in grain:
        test = F.col(f"`{k}`").eqNullSafe(F.col(f"`{right_keys[k]}`"))
        same = test if same is None else same & test
    joined = left.join(renamed, same, "full")
    keys = [F.coalesce(F.col(f"`{k}`"), F.col(f"`{right_keys[k]}`")).alias(k) for k in grain]
    rest = [c for c in joined.columns if c not in grain and c not in right_keys.values()]
    return joined.select(*keys, *rest)


def orphans(df: DataFrame, keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Rows whose reference has no target (a NULL reference has none either)."""
    known = parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys)]).distinct()
    return df.join(known, list(keys), "left_anti")


def match_ratio(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Share of rows whose key exists in the parent; rows are counted per key before the join."""
    counts = df.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.count("*").alias("__rows"))
    known = parent.select(F.col(f"`{parent_key}`").alias("__known")).distinct()
    joined = counts.join(known, F.col("__key") == F.col("__known"), "left")
    matched = F.coalesce(F.sum(F.when(F.col("__known").isNotNull(), F.col("__rows"))), F.lit(0))
    total = F.sum("__rows")
    return joined.agg(
        F.lit(key).alias("join_key"), total.alias("rows"), matched.alias("matched_rows"),
        F.round(F.try_divide(matched, total), 4).alias("match_ratio"),
    )
