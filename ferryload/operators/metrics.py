"""Business roles, KPI catalogue and its execution, hierarchies, glossary.

Everything works on catalogue tables keyed by ``table_name``, so one job covers any number of tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    DOMAIN_STOP_TOKENS,
    GLOSSARY_OWNER,
    HIERARCHY_CONFIDENCE,
    HIERARCHY_PATTERNS,
    HIERARCHY_REASON,
    READINESS_BASE,
    READINESS_POINTS,
)
from ferryload.functions.aggregates import kpi_aggregation
from ferryload.functions.classes import column_role, kpi_theme
from ferryload.functions.text import business_name, display_name, snake_words


def entities(fields: DataFrame) -> DataFrame:
    """K1, K5: role and business name of every field.

    ``fields`` has ``table_name, position, field_name, tags, inferred_category,
    detected_runtime_type, target_column, target_type, distinct_count``.
    """
    role = column_role(F.col("field_name"), F.col("tags"), F.col("inferred_category"), F.col("detected_runtime_type"))
    return fields.withColumn("__role", role).select(
        "table_name", "position", F.col("field_name").alias("source_column"), "target_column", "target_type",
        "__role.entity_type", business_name(F.col("field_name")).alias("business_name"),
        "__role.confidence", "__role.reason", "distinct_count",
    )


def entity_summary(found: DataFrame) -> DataFrame:
    """K8: number of fields per role and table."""
    kinds = {"dimensions": "DIMENSION", "measures": "MEASURE", "dates": "DATE", "flags": "FLAG", "identifiers": "IDENTIFIER"}
    return found.groupBy("table_name").agg(
        *[F.count_if(F.col("entity_type") == kind).alias(f"{name}_count") for name, kind in kinds.items()]
    )


def _target_name() -> Column:
    known = F.col("target_column").isNotNull() & (F.col("target_column") != "")
    return F.when(known, F.col("target_column")).otherwise(snake_words(F.col("source_column")))


def _ranked(found: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Fields of a role, numbered per table; only the first ``limit``, if one is given."""
    order = Window.partitionBy("table_name").orderBy("position")
    ranked = found.where(F.col("entity_type") == kind).withColumn("__r", F.row_number().over(order))
    return ranked.where(F.col("__r") <= limit) if limit else ranked


def kpi_catalog(found: DataFrame, limit: int | None = None) -> DataFrame:
    """A KPI per measure and flag with formula, grain, dimensions (all, or the first ``limit``) and date column."""
    dimensions = _ranked(found, "DIMENSION", limit).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("__r", "business_name", _target_name().alias("target")))).alias("d")
    )
    dates = _ranked(found, "DATE", 1).select(
        "table_name", F.col("business_name").alias("date_name"), _target_name().alias("date_column")
    )
    names = F.concat(
        F.transform("d", lambda s: s["business_name"]),
        F.when(F.col("date_name").isNotNull(), F.array("date_name")).otherwise(F.array().cast("array<string>")),
    )
    context = dimensions.join(dates, "table_name", "full").withColumn(
        "d", F.coalesce("d", F.array().cast("array<struct<__r:int,business_name:string,target:string>>"))
    ).select(
        "table_name", F.concat(F.lit("By "), F.array_join(names, ", ")).alias("grain"),
        F.transform("d", lambda s: s["target"]).alias("dimensions"), "date_column",
    )
    chosen = kpi_aggregation(
        F.col("entity_type"), F.lower(F.concat_ws(" ", "source_column", "target_column")),
        F.coalesce("target_type", F.lit("")),
    )
    kpi_name = display_name(F.col("source_column"))
    return (
        found.where(F.col("entity_type").isin("MEASURE", "FLAG"))
        .withColumn("__a", chosen).join(context, "table_name", "left")
        .select(
            "table_name", "position", kpi_name.alias("kpi_name"),
            F.concat(kpi_name, F.lit(" derived from `"), "source_column", F.lit("`.")).alias("business_description"),
            "source_column", "entity_type",
            F.concat("__a.aggregation_type", F.lit("("), _target_name(), F.lit(")")).alias("recommended_formula"),
            "__a.aggregation_type", F.coalesce("grain", F.lit("Table grain")).alias("grain"),
            F.coalesce("dimensions", F.array().cast("array<string>")).alias("dimensions"),
            F.coalesce("date_column", F.lit("")).alias("date_column"), "__a.confidence", "__a.reason",
        )
    )


def kpi_value(aggregation: str, column: str) -> Column:
    """K3: the formula as an expression. Booleans are counted when known, or summed as 0/1."""
    value = F.col(f"`{column}`")
    if aggregation == "COUNT":
        return F.count(value).cast("double")
    return {"SUM": F.sum, "AVG": F.avg}[aggregation](value.cast("double"))


def run_kpis(df: DataFrame, kpis: Sequence[tuple[str, str, str]], grain: dict[str, Column] | None = None) -> DataFrame:
    """K3: values of all KPIs ``(name, aggregation, column)`` per grain key, in one aggregation."""
    grain = grain or {}
    values = [kpi_value(aggregation, column).alias(name) for name, aggregation, column in kpis]
    keys = [value.alias(name) for name, value in grain.items()]
    wide = df.groupBy(*keys).agg(*values) if keys else df.agg(*values)
    return wide.unpivot(list(grain), [name for name, _, _ in kpis], "kpi_name", "kpi_value")


def run_kpis_by_grain(df: DataFrame, kpis: Sequence[tuple[str, str, str]], grains: dict[str, Column]) -> DataFrame:
    """K3: values of all KPIs overall and per grain, each grain alone, in one pass over the rows: ``grain`` ('overall' or
    its name), ``grain_key``, ``kpi_name``, ``kpi_value``."""
    names = list(grains)
    keyed = df.select("*", *[value.cast("string").alias(f"__{name}") for name, value in grains.items()])
    keys = [F.col(f"__{name}") for name in names]
    values = [kpi_value(aggregation, column).alias(name) for name, aggregation, column in kpis]
    wide = keyed.groupingSets([[], *[[key] for key in keys]], *keys).agg(F.grouping_id().alias("__set"), *values)
    grain, grain_key = F.lit("overall"), F.lit(None).cast("string")
    for i, name in enumerate(names):  # a bit per key is set where it is folded
        alone = F.col("__set") == 2 ** len(names) - 1 - 2 ** (len(names) - 1 - i)
        grain, grain_key = F.when(alone, F.lit(name)).otherwise(grain), F.when(alone, F.col(f"__{name}")).otherwise(grain_key)
    shaped = wide.select(grain.alias("grain"), grain_key.alias("grain_key"), *[name for name, _, _ in kpis])
    return shaped.unpivot(["grain", "grain_key"], [name for name, _, _ in kpis], "kpi_name", "kpi_value")


def hierarchy_candidates(found: DataFrame) -> DataFrame:
    """K4: every dimension and identifier that a level's token names, one row per pattern, level and column.

    ``is_chosen`` marks the column that stands for the level: the first of its table by position.
    """
    levels = F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.lit(level).alias("level"), F.lit(token).alias("token"))
        for p, tokens in enumerate(HIERARCHY_PATTERNS) for level, token in enumerate(tokens)
    ])
    named = found.where(F.col("entity_type").isin("DIMENSION", "IDENTIFIER"))
    hits = named.select("*", F.explode(levels).alias("l")).where(F.lower("source_column").contains(F.col("l.token")))
    first = Window.partitionBy("table_name", "l.pattern", "l.level").orderBy("position")
    of_pattern = Window.partitionBy("table_name", "l.pattern")
    return hits.select(
        "table_name", F.col("l.pattern").alias("pattern_number"), F.col("l.level").alias("level"), F.col("l.token").alias("token"), "position",
        "source_column", _target_name().alias("target_column"), "business_name", "distinct_count",
        (F.row_number().over(first) == 1).alias("is_chosen"),
        F.size(F.collect_set("l.level").over(of_pattern)).alias("level_count"),  # a pattern has a few levels
    )


def hierarchies(found: DataFrame) -> DataFrame:
    """K4: token sequences present in a table's dimensions and identifiers, two levels at least."""
    chosen = hierarchy_candidates(found).where("is_chosen AND level_count >= 2")
    columns = ["source_column", "target_column", "business_name", "distinct_count"]
    per_pattern = chosen.groupBy("table_name", "pattern_number").agg(
        F.array_sort(F.collect_list(F.struct("level", F.struct(*columns).alias("first")))).alias("levels")
    )
    join = lambda name: F.array_join(F.transform("levels", lambda s: s["first"][name].cast("string")), " > ")
    return per_pattern.select(
        "table_name", "pattern_number", F.size("levels").alias("level_count"),
        join("business_name").alias("business_name"), join("source_column").alias("source_column"),
        join("target_column").alias("target_column"), join("distinct_count").alias("distinct_counts"),
        F.lit(HIERARCHY_CONFIDENCE).alias("confidence"),
    )


def dependencies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """K4: for every pair (upper, lower) of columns, how many lower values belong to more than one upper value.

    All pairs are counted in one aggregation: a row gives one (pair, lower, upper), and equal ones meet before the shuffle.
    """
    asked = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(f"`{upper}`").cast("string").alias("upper"), F.col(f"`{lower}`").cast("string").alias("lower"))
        for i, (upper, lower) in enumerate(pairs)
    ])
    distinct = df.select(F.inline(asked)).distinct()
    parents = distinct.groupBy("pair", "lower").agg(F.count(F.lit(1)).alias("parents"))
    counts = parents.groupBy("pair").agg(F.count("*").alias("lower_values"), F.count_if(F.col("parents") > 1).alias("ambiguous_values"))
    names = df.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "pair int, upper_level string, lower_level string")
    return names.join(counts, "pair").select("upper_level", "lower_level", "lower_values", "ambiguous_values")


def level_dependency(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """K4: :func:`dependencies` of neighbouring levels."""
    return dependencies(df, list(zip(levels, levels[1:])))


def measured_levels(df: DataFrame, candidates: Sequence[tuple[int, int, str]]) -> DataFrame:
    """K4: every candidate (pattern, level, column) with the share of its values that belong to one value of a column of the
    next level above, for all such columns; ``is_dependent`` where all of them do. No candidate is left out: the top level,
    and a level whose upper one is empty, have no upper column."""
    above = {}
    for pattern, level, column in candidates:
        upper_levels = sorted({above_level for p, above_level, _ in candidates if p == pattern and above_level < level})
        uppers = [c for p, l, c in candidates if upper_levels and (p, l) == (pattern, upper_levels[-1]) and c != column]
        above[pattern, level, column] = uppers or [None]
    listed = df.sparkSession.createDataFrame(
        [(*key, upper) for key, uppers in above.items() for upper in uppers], "pattern_number int, level int, lower_level string, upper_level string")
    pairs = sorted({(upper, key[2]) for key, uppers in above.items() for upper in uppers if upper})
    none = "lower_level string, upper_level string, lower_values bigint, ambiguous_values bigint"
    counts = dependencies(df, pairs) if pairs else df.sparkSession.createDataFrame([], none)
    share = F.round(1 - F.try_divide(F.col("ambiguous_values"), F.col("lower_values")), 4)
    return listed.join(counts, ["upper_level", "lower_level"], "left").select(
        "pattern_number", "level", "lower_level", "upper_level", "lower_values", "ambiguous_values", share.alias("dependent_share"),
        (F.col("ambiguous_values") == 0).alias("is_dependent"))


def glossary(kpis: DataFrame, found: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """K6: KPI, dimension and hierarchy terms in one table."""

    def terms(df: DataFrame, kind: str, name: str, text: Column, source: str, used: Column, date: Column) -> DataFrame:
        return df.select(
            "table_name", F.lit(kind).alias("term_type"), F.col(name).alias("name"), text.alias("business_definition"),
            F.col(source).alias("source_columns"), used.alias("dimensions_used"), date.alias("date_grain"),
            F.lit(GLOSSARY_OWNER).alias("owner"), F.col("confidence"),
        )

    dated = F.when(F.col("date_column") != "", F.col("date_column")).otherwise("not_specified")
    none, not_applicable = F.lit(""), F.lit("not_applicable")
    return reduce(DataFrame.unionByName, [
        terms(kpis, "KPI", "kpi_name", F.col("business_description"), "source_column",
              F.array_join("dimensions", "|"), dated),
        terms(found.where(F.col("entity_type") == "DIMENSION"), "DIMENSION", "business_name", F.col("reason"),
              "source_column", none, not_applicable),
        terms(hierarchy, "HIERARCHY", "business_name",
              F.lit(HIERARCHY_REASON),
              "source_column", none, not_applicable),
    ])


def readiness(
    found: DataFrame, kpis: DataFrame, hierarchy: DataFrame, rules: DataFrame, approved: DataFrame
) -> DataFrame:
    """K7: score per table: base points plus points for each kind of result that exists, at most 100."""
    parts = {
        "dimensions": found.where(F.col("entity_type") == "DIMENSION"), "kpis": kpis, "hierarchies": hierarchy,
        "rules": rules, "approved_mapping": approved,
    }
    present = [df.select("table_name", F.lit(name).alias("part")).distinct() for name, df in parts.items()]
    base = found.select("table_name", F.lit("base").alias("part")).distinct()
    points = F.lit(0)
    for name, value in READINESS_POINTS.items():
        points = F.when(F.col("part") == name, value).otherwise(points)
    return reduce(DataFrame.unionByName, [base, *present]).groupBy("table_name").agg(
        F.least(F.lit(READINESS_BASE) + F.sum(points), F.lit(100)).alias("readiness_score"),
        F.count_if(F.col("part") != "base").alias("parts_present"),
    )


def kpis_by_theme(kpis: DataFrame) -> DataFrame:
    """K9: KPIs per theme."""
    text = F.concat_ws(" ", "kpi_name", "business_description", "recommended_formula")
    return kpis.groupBy(kpi_theme(text).alias("theme")).agg(F.count("*").alias("kpi_count"))


def layered_lineage(found: DataFrame, kpis: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Edges source → bronze → silver → gold → KPI of every table, each edge once."""

    def node(kind: str, name: Column) -> Column:
        return F.concat(F.lit(f"{kind}_"), snake_words(name))

    def edges(df: DataFrame, start: Column, end: Column, label: str) -> DataFrame:
        return df.select("table_name", start.alias("from_node"), end.alias("to_node"), F.lit(label).alias("label"))

    tables = found.select("table_name").distinct()
    source, bronze, silver, gold = F.lit("source"), F.lit("bronze_table"), F.lit("silver_table"), F.lit("gold_kpi")
    dimensions = found.where(F.col("entity_type") == "DIMENSION")
    measures = found.where(F.col("entity_type") == "MEASURE")
    dimension_node, measure_node = node("dimension", _target_name()), node("measure", _target_name())
    kpi_node, hierarchy_node = node("kpi", F.col("kpi_name")), node("hierarchy", F.col("source_column"))
    slices = kpis.select("table_name", "kpi_name", F.explode("dimensions").alias("dimension"))
    levels = hierarchy.select(
        "table_name", "source_column", F.explode(F.split("target_column", " > ")).alias("level")
    )
    return reduce(DataFrame.unionByName, [
        edges(tables, source, bronze, "ingested as"), edges(tables, bronze, silver, "modeled in"),
        edges(tables, silver, gold, "aggregated into"),
        edges(dimensions, source, dimension_node, "provides field"),
        edges(measures, source, measure_node, "provides field"),
        edges(dimensions, dimension_node, silver, "modeled in"), edges(measures, measure_node, silver, "modeled in"),
        edges(hierarchy, silver, hierarchy_node, "defines hierarchy"),
        edges(levels, node("dimension", F.col("level")), hierarchy_node, "hierarchy level"),
        edges(kpis, gold, kpi_node, "aggregated into"),
        edges(kpis, node("measure", F.col("source_column")), kpi_node, "feeds KPI"),
        edges(slices, node("dimension", F.col("dimension")), kpi_node, "slices KPI"),
    ]).distinct()


def business_domain(found: DataFrame) -> DataFrame:
    """Domain of a table: first telling word in its measure names, else its own name."""
    words = found.where(F.col("entity_type") == "MEASURE").select(
        "table_name", "position", F.posexplode(F.split(snake_words(_target_name()), "_")).alias("word_position", "word")
    ).where((F.col("word") != "") & ~F.col("word").isin(DOMAIN_STOP_TOKENS))
    telling = words.groupBy("table_name").agg(F.min(F.struct("position", "word_position", "word"))["word"].alias("word"))
    kinds = found.groupBy("table_name").agg(F.bool_or(F.col("entity_type") == "MEASURE").alias("has_measures"))
    own = F.regexp_replace(snake_words(F.col("table_name")), "(_raw|_fact|_table)$", "")
    domain = F.coalesce("word", own)
    return kinds.join(telling, "table_name", "left").select(
        "table_name", domain.alias("domain"),
        F.concat(F.lit("silver."), F.when(F.col("has_measures"), "fact").otherwise("dim"), F.lit("_"), domain).alias("silver_table"),
        F.concat(F.lit("gold."), domain, F.lit("_kpis")).alias("gold_table"),
    )
