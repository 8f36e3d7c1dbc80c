"""Queries for roles, KPIs, hierarchies, glossary, rules and layered lineage (K*, R3, R5, G6, G15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload import fixed_values as fixed
from ferryload.functions.classes import field_category, target_type
from ferryload.functions.text import column_name
from ferryload.operators import joins, metrics, profiling, reconcile
from ferryload.plans.loading import RESERVED, snake_sql
from ferryload.plans.quality import profile_sql
from ferryload.plans.tables import Tables

# Field lists of the two business tables below: name and kind.
MODEL = {
    "sales": [("OrderKey", "numeric"), ("CustomerName", "text"), ("MarketSegment", "text"), ("SalesChannel", "text"), ("Region", "text"),
              ("CountryName", "text"), ("OrderStatus", "text"), ("OpenFlag", "numeric"), ("ActualSales", "numeric"),
              ("GrossMarginRate", "numeric"), ("OrderDate", "date")],
    "shipments": [("PartCode", "numeric"), ("Brand", "text"), ("CategoryType", "text"), ("ShipPlatform", "text"), ("SupplierArea", "numeric"),
                  ("ShippedUnits", "numeric"), ("NetValue", "numeric"), ("PyQty", "numeric"), ("DiscountPercent", "numeric"),
                  ("is_returned", "text"), ("ShipDate", "date")],
}


def sales(t: Tables):
    rows = t.plain("orders")
    for table in (
        t.plain("customer").select("custkey", "nationkey", "mktsegment", "acctbal", F.col("name").alias("CustomerName")),
        t.plain("nation").select("nationkey", "regionkey", F.col("name").alias("CountryName")),
        t.plain("region").select("regionkey", F.col("name").alias("Region")),
    ):
        rows = joins.natural_join(rows, table, "left", unique_right=True)
    return rows.select(
        F.col("orderkey").alias("OrderKey"), "CustomerName", F.col("mktsegment").alias("MarketSegment"), F.col("orderpriority").alias("SalesChannel"),
        "Region", "CountryName", F.col("orderstatus").alias("OrderStatus"), (F.col("orderstatus") == "O").cast("bigint").alias("OpenFlag"),
        F.col("totalprice").alias("ActualSales"), (F.col("acctbal") / 10000).alias("GrossMarginRate"), F.col("orderdate").cast("date").alias("OrderDate"),
    )


def shipments(t: Tables):
    rows = t.plain("lineitem")
    for table in (t.plain("part").select("partkey", "brand", "type"), t.plain("supplier").select("suppkey", "nationkey")):
        rows = joins.natural_join(rows, table, "left", unique_right=True)
    return rows.select(
        F.col("partkey").alias("PartCode"), F.col("brand").alias("Brand"), F.col("type").alias("CategoryType"), F.col("linestatus").alias("ShipPlatform"),
        F.col("nationkey").cast("bigint").alias("SupplierArea"), F.col("quantity").alias("ShippedUnits"), F.col("extendedprice").alias("NetValue"),
        F.col("linenumber").cast("bigint").alias("PyQty"), F.col("discount").alias("DiscountPercent"), (F.col("returnflag") == "R").alias("is_returned"),
        F.col("shipdate").cast("date").alias("ShipDate"),
    )


def listed_fields(t: Tables):
    """Fields of both tables with their class."""
    listed = t.spark.createDataFrame(
        [(name, i, field, [f"${kind}"]) for name, fields in MODEL.items() for i, (field, kind) in enumerate(fields)],
        "table_name string, position int, field_name string, tags array<string>",
    )
    return listed.withColumn("inferred_category", field_category(F.col("field_name"), F.col("tags"), F.lit("")))


def found(t: Tables, counted: bool = False):
    """Entities of both tables, from one pass over each. Distinct values are counted where they decide a type (flags), or
    for all fields if ``counted``. The facts are one row per field and are read several times, so they are computed here."""
    facts = None
    for name, df in {"sales": sales(t), "shipments": shipments(t)}.items():
        asked = [c for c in df.columns if counted or any(token in c.lower() for token in fixed.FLAG_TOKENS)]
        part = profiling.column_facts(df, exact=asked).withColumn("table_name", F.lit(name))
        facts = part if facts is None else facts.unionByName(part)
    facts = facts.select("table_name", "column_name", "distinct_count", profiling.runtime_type(F.lit("")).alias("detected_runtime_type"))
    facts = t.spark.createDataFrame(facts.collect(), facts.schema)  # one row per field
    typed = listed_fields(t).join(facts.withColumnRenamed("column_name", "field_name"), ["table_name", "field_name"], "left").withColumn(
        "__t", target_type(F.col("inferred_category"), F.col("field_name"), F.col("distinct_count"), F.lit(None).cast("string"))
    )
    named = typed.withColumn("target_column", column_name(F.col("field_name"))).withColumn("target_type", F.col("__t.target_type"))
    return metrics.entities(named)


def _dimensions(entities):
    return entities.where("entity_type = 'DIMENSION'").select("table_name", F.col("target_column").alias("dimension"), "position")


def column_roles(t: Tables):
    return found(t, counted=True).withColumn("position", F.col("position").cast("bigint"))


def entity_summary(t: Tables):
    return metrics.entity_summary(found(t))


def kpi_catalog(t: Tables):
    return metrics.kpi_catalog(found(t)).withColumn("dimensions", F.array_join("dimensions", "|")).drop("position", "reason")


def kpi_themes(t: Tables):
    return metrics.kpis_by_theme(metrics.kpi_catalog(found(t)))


KPIS = [("sales_sum", "SUM", "ActualSales"), ("margin_avg", "AVG", "GrossMarginRate"), ("open_count", "COUNT", "OpenFlag")]


def kpi_run(t: Tables):
    grains = {"region": F.col("Region"), "year": F.date_format("OrderDate", "yyyy"), "month": F.date_format("OrderDate", "yyyy-MM")}
    return metrics.run_kpis_by_grain(sales(t), KPIS, grains).withColumn("kpi_value", F.round("kpi_value", 2))


def hierarchy_levels(t: Tables):
    return metrics.hierarchies(found(t, counted=True)).select(
        "table_name", F.col("level_count").cast("bigint").alias("level_count"), "business_name", "source_column", "target_column", "distinct_counts", "confidence"
    )


def hierarchy_candidates(t: Tables):
    return metrics.hierarchy_candidates(found(t, counted=True)).select(
        "table_name", F.col("pattern_number").cast("bigint").alias("pattern_number"), F.col("level").cast("bigint").alias("level"), "token",
        "source_column", "target_column", "distinct_count", "is_chosen", F.col("level_count").cast("bigint").alias("level_count"))


LEVELS = [(0, 0, "Region"), (0, 1, "CountryName"), (3, 0, "CustomerName"), (3, 1, "MarketSegment"), (3, 1, "OrderStatus"), (3, 2, "SalesChannel")]


def measured_levels(t: Tables):
    rows = metrics.measured_levels(sales(t), LEVELS)
    return rows.select("*", *[F.col(c).cast("bigint").alias(f"{c}_") for c in ("pattern_number", "level")]).drop("pattern_number", "level").withColumnsRenamed(
        {"pattern_number_": "pattern_number", "level_": "level"})


def level_dependency(t: Tables):
    return metrics.level_dependency(sales(t), ["Region", "CountryName", "CustomerName", "OrderStatus"])


def glossary(t: Tables):
    entities = found(t)
    return metrics.glossary(metrics.kpi_catalog(entities), entities, metrics.hierarchies(entities))


def reconciliation_rules(t: Tables):
    return _rules(found(t))


def _rules(entities):
    return reconcile.reconciliation_rules(metrics.kpi_catalog(entities), _dimensions(entities))


def rules_by_metric(t: Tables):
    return reconcile.rules_by_metric(reconciliation_rules(t))


def readiness(t: Tables):
    entities = found(t)
    kpis, approved = metrics.kpi_catalog(entities), entities.where("table_name = 'sales'")
    return metrics.readiness(entities, kpis, metrics.hierarchies(entities), _rules(entities), approved).select(
        "table_name", F.col("readiness_score").cast("bigint").alias("readiness_score"), "parts_present"
    )


def layered_lineage(t: Tables):
    entities = found(t)
    return metrics.layered_lineage(entities, metrics.kpi_catalog(entities), metrics.hierarchies(entities))


def business_domain(t: Tables):
    return metrics.business_domain(found(t))


QUERIES = {f.__name__: f for f in (
    column_roles, entity_summary, kpi_catalog, kpi_themes, kpi_run, hierarchy_levels, hierarchy_candidates, measured_levels,
    level_dependency, glossary,
    reconciliation_rules, rules_by_metric, readiness, layered_lineage, business_domain,
)}

TABLES_SQL = """
sales AS (
  SELECT o_orderkey AS "OrderKey", c_name AS "CustomerName", c_mktsegment AS "MarketSegment", o_orderpriority AS "SalesChannel", r_name AS "Region",
    n_name AS "CountryName", o_orderstatus AS "OrderStatus", CAST(o_orderstatus = 'O' AS BIGINT) AS "OpenFlag", o_totalprice AS "ActualSales",
    c_acctbal / 10000 AS "GrossMarginRate", CAST(o_orderdate AS DATE) AS "OrderDate"
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
shipments AS (
  SELECT l_partkey AS "PartCode", p_brand AS "Brand", p_type AS "CategoryType", l_linestatus AS "ShipPlatform", s_nationkey AS "SupplierArea",
    l_quantity AS "ShippedUnits", l_extendedprice AS "NetValue", l_linenumber AS "PyQty", l_discount AS "DiscountPercent", l_returnflag = 'R' AS is_returned,
    CAST(l_shipdate AS DATE) AS "ShipDate"
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

_LISTED = ", ".join(f"('{n}', {i}, '{f}', '{k}')" for n, fields in MODEL.items() for i, (f, k) in enumerate(fields))
_PROFILES = " UNION ALL ".join(f"SELECT '{n}' AS table_name, * FROM ({profile_sql(n, f)})" for n, fields in MODEL.items() for f, _ in fields)


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{word}'" for word in words)


def _any(column: str, tokens: list[str]) -> str:
    return f"regexp_matches(lower({column}), '{'|'.join(tokens)}')"


_F = "source_column"
_KEY, _DATE, _FLAG = _any(_F, fixed.KEY_TOKENS), _any(_F, fixed.DATE_TOKENS), _any(_F, fixed.FLAG_TOKENS)
_MEASURE = _any(_F, fixed.MEASURE_TOKENS)
_DIMENSION = _any(_F, fixed.DIMENSION_TOKENS)

_PATTERNS = ", ".join(f"({p}, {level}, '{token}')" for p, tokens in enumerate(fixed.HIERARCHY_PATTERNS) for level, token in enumerate(tokens))

FOUND = TABLES_SQL + f""",
listed(table_name, position, source_column, kind) AS (VALUES {_LISTED}),
prof AS ({_PROFILES}),
cat AS (
  SELECT l.*, p.distinct_count, p.detected_runtime_type AS rt,
    CASE WHEN kind = 'date' OR {_DATE} THEN 'DATE_LIKE' WHEN {_KEY} THEN 'KEY_LIKE' WHEN kind = 'text' THEN 'TEXT_LIKE' WHEN {_FLAG} THEN 'FLAG_LIKE'
         WHEN kind = 'numeric' THEN 'NUMERIC_LIKE' ELSE 'UNKNOWN' END AS cl, {snake_sql(_F)} AS s
  FROM listed l JOIN prof p ON l.table_name = p.table_name AND l.source_column = p.column_name),
roles AS (
  SELECT *, CASE WHEN s IN ({RESERVED}) THEN s || '_col' ELSE s END AS target_column,
    CASE cl WHEN 'DATE_LIKE' THEN 'DATE' WHEN 'TEXT_LIKE' THEN 'STRING' WHEN 'KEY_LIKE' THEN 'STRING'
      WHEN 'FLAG_LIKE' THEN CASE WHEN distinct_count <= 2 THEN 'BOOLEAN' ELSE 'INT' END
      WHEN 'NUMERIC_LIKE' THEN CASE WHEN {_any(_F, fixed.COUNT_TOKENS)} THEN 'BIGINT'
        WHEN {_any(_F, fixed.DECIMAL_TOKENS)} THEN 'DECIMAL(18,2)' ELSE 'DOUBLE' END ELSE 'STRING' END AS target_type,
    CASE WHEN cl = 'DATE_LIKE' THEN 'DATE' WHEN {_FLAG} OR rt = 'BOOLEAN_LIKE' OR cl = 'FLAG_LIKE' THEN 'FLAG' WHEN cl = 'KEY_LIKE' THEN 'IDENTIFIER'
      WHEN {_MEASURE} OR cl = 'NUMERIC_LIKE' OR rt IN ('INTEGER', 'DECIMAL') THEN 'MEASURE' ELSE 'DIMENSION' END AS entity_type,
    (cl = 'TEXT_LIKE' OR {_DIMENSION}) AS telling,
    regexp_replace(regexp_replace(source_column, '_', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS spaced
  FROM cat),
found AS (
  SELECT *, list_aggregate(list_transform(string_split(spaced, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS business_name,
    CAST(CASE entity_type WHEN 'DATE' THEN 0.92 WHEN 'FLAG' THEN 0.88 WHEN 'IDENTIFIER' THEN 0.86 WHEN 'MEASURE' THEN 0.84 ELSE CASE WHEN telling THEN 0.82 ELSE 0.55 END END AS DOUBLE) AS confidence,
    CASE entity_type WHEN 'DATE' THEN 'Date metadata, tags, or field name detected.' WHEN 'FLAG' THEN 'Flag-like name or boolean-like profile values detected.'
      WHEN 'IDENTIFIER' THEN 'Identifier-like field name detected.' WHEN 'MEASURE' THEN 'Numeric metric naming or runtime profile detected.'
      ELSE CASE WHEN telling THEN 'Descriptive text or common business dimension name detected.' ELSE 'Defaulted to descriptive dimension pending review.' END END AS reason
  FROM roles),
dims AS (
  SELECT table_name, list(target_column ORDER BY position) AS targets, list(business_name ORDER BY position) AS names
  FROM found WHERE entity_type = 'DIMENSION' GROUP BY 1),
dates AS (SELECT table_name, first(target_column ORDER BY position) AS date_column, first(business_name ORDER BY position) AS date_name FROM found WHERE entity_type = 'DATE' GROUP BY 1),
kpi0 AS (
  SELECT f.*, d.targets, date_column, 'By ' || array_to_string(list_append(d.names, date_name), ', ') AS grain,
    CASE WHEN entity_type = 'FLAG' THEN CASE WHEN target_type = 'BOOLEAN' THEN 'COUNT' ELSE 'SUM' END
         WHEN {_any(_F, fixed.AVG_TOKENS)} THEN 'AVG' ELSE 'SUM' END AS aggregation_type,
    list_aggregate(list_transform(string_split(s, '_'), lambda w: CASE w WHEN 'py' THEN 'Prior Year' WHEN 'qty' THEN 'Quantity' ELSE upper(w[1]) || w[2:] END), 'string_agg', ' ') AS kpi_name
  FROM found f LEFT JOIN dims d USING (table_name) LEFT JOIN dates USING (table_name) WHERE entity_type IN ('MEASURE', 'FLAG')),
kpis AS (
  SELECT *, kpi_name || ' derived from `' || source_column || '`.' AS business_description, aggregation_type || '(' || target_column || ')' AS recommended_formula,
    CAST(CASE WHEN entity_type = 'FLAG' THEN CASE aggregation_type WHEN 'COUNT' THEN 0.68 ELSE 0.72 END WHEN aggregation_type = 'AVG' THEN 0.78
      WHEN {_any(_F, fixed.SUM_TOKENS)} THEN 0.86 ELSE 0.6 END AS DOUBLE) AS kpi_confidence,
    targets AS dimensions FROM kpi0),
patterns(p, l, token) AS (VALUES {_PATTERNS}),
hits AS (
  SELECT table_name, p, l, first(business_name ORDER BY position) AS b, first(source_column ORDER BY position) AS s, first(target_column ORDER BY position) AS t,
    first(distinct_count ORDER BY position) AS n
  FROM found, patterns WHERE entity_type IN ('DIMENSION', 'IDENTIFIER') AND contains(lower(source_column), token) GROUP BY ALL),
hier AS (
  SELECT table_name, p, count(*) AS level_count, string_agg(b, ' > ' ORDER BY l) AS business_name, string_agg(s, ' > ' ORDER BY l) AS source_column,
    string_agg(t, ' > ' ORDER BY l) AS target_column, string_agg(CAST(n AS VARCHAR), ' > ' ORDER BY l) AS distinct_counts
  FROM hits GROUP BY 1, 2 HAVING count(*) >= 2),
major AS (
  SELECT table_name, target_column AS dimension FROM (SELECT *, CASE WHEN contains(target_column, 'region') THEN 0 WHEN contains(target_column, 'country') THEN 1
    WHEN contains(target_column, 'category') THEN 2 WHEN contains(target_column, 'franchise') THEN 3 END AS k FROM found WHERE entity_type = 'DIMENSION')
  WHERE k IS NOT NULL),
rules AS (
  SELECT table_name, kpi_name AS metric_name, 'reconcile_' || lower(replace(kpi_name, ' ', '_')) AS rule_name, 'overall' AS date_grain, CAST(NULL AS VARCHAR) AS dimension FROM kpis
  UNION ALL SELECT table_name, kpi_name, 'reconcile_' || lower(replace(kpi_name, ' ', '_')) || '_by_month', 'month', date_column FROM kpis
  UNION ALL SELECT table_name, kpi_name, 'reconcile_' || lower(replace(kpi_name, ' ', '_')) || '_by_' || dimension, 'overall', dimension FROM kpis JOIN major USING (table_name))"""

_KPI_TEXT = "lower(kpi_name || ' ' || business_description || ' ' || recommended_formula)"
_VALUES = "round(sum(\"ActualSales\"), 2) AS sales_sum, round(avg(\"GrossMarginRate\"), 2) AS margin_avg, CAST(count(\"OpenFlag\") AS DOUBLE) AS open_count"
_EDGE = "SELECT table_name, {a} AS from_node, {b} AS to_node, '{l}' AS label FROM {f}"

ORACLE = {
    "column_roles": f"""WITH {FOUND} SELECT table_name, position::BIGINT AS position, source_column, target_column, target_type, entity_type, business_name, confidence, reason, distinct_count FROM found""",
    "entity_summary": f"""
      WITH {FOUND} SELECT table_name, count(*) FILTER (entity_type = 'DIMENSION') AS dimensions_count, count(*) FILTER (entity_type = 'MEASURE') AS measures_count,
        count(*) FILTER (entity_type = 'DATE') AS dates_count, count(*) FILTER (entity_type = 'FLAG') AS flags_count, count(*) FILTER (entity_type = 'IDENTIFIER') AS identifiers_count
      FROM found GROUP BY 1""",
    "kpi_catalog": f"""
      WITH {FOUND} SELECT table_name, kpi_name, business_description, source_column, entity_type, recommended_formula, aggregation_type, grain,
        array_to_string(dimensions, '|') AS dimensions, date_column, kpi_confidence AS confidence FROM kpis""",
    "kpi_themes": f"""
      WITH {FOUND} SELECT CASE WHEN regexp_matches({_KPI_TEXT}, 'sales|revenue|amount|price|value') THEN 'Sales / revenue metrics'
        WHEN regexp_matches({_KPI_TEXT}, 'budget|plan') THEN 'Budget / planning metrics' WHEN regexp_matches({_KPI_TEXT}, 'forecast') THEN 'Forecast metrics'
        WHEN regexp_matches({_KPI_TEXT}, 'growth|variance|difference|margin|yoy') THEN 'Growth / variance metrics'
        WHEN regexp_matches({_KPI_TEXT}, 'ops|units|quantity|count|cost') THEN 'Operational metrics'
        WHEN regexp_matches({_KPI_TEXT}, 'flag|indicator|active|enabled') THEN 'Flag / indicator metrics' ELSE 'Other metrics' END AS theme, count(*) AS kpi_count
      FROM kpis GROUP BY 1""",
    "kpi_run": f"""
      WITH {TABLES_SQL}, w AS (
        SELECT 'overall' AS grain, CAST(NULL AS VARCHAR) AS grain_key, {_VALUES} FROM sales
        UNION ALL SELECT 'region', "Region", {_VALUES} FROM sales GROUP BY 2
        UNION ALL SELECT 'year', strftime("OrderDate", '%Y'), {_VALUES} FROM sales GROUP BY 2
        UNION ALL SELECT 'month', strftime("OrderDate", '%Y-%m'), {_VALUES} FROM sales GROUP BY 2)
      SELECT grain, grain_key, 'sales_sum' AS kpi_name, sales_sum AS kpi_value FROM w UNION ALL SELECT grain, grain_key, 'margin_avg', margin_avg FROM w
      UNION ALL SELECT grain, grain_key, 'open_count', open_count FROM w""",
    "hierarchy_levels": f"WITH {FOUND} SELECT table_name, level_count, business_name, source_column, target_column, distinct_counts, 0.72::DOUBLE AS confidence FROM hier",
    "hierarchy_candidates": f"""
      WITH {FOUND}, h AS (SELECT *, p::BIGINT AS pattern_number, l::BIGINT AS level FROM found, patterns
        WHERE entity_type IN ('DIMENSION', 'IDENTIFIER') AND contains(lower(source_column), token))
      SELECT table_name, pattern_number, level, token, source_column, target_column, distinct_count,
        row_number() OVER (PARTITION BY table_name, p, l ORDER BY position) = 1 AS is_chosen, n.level_count
      FROM h JOIN (SELECT table_name, p, count(DISTINCT l) AS level_count FROM h GROUP BY ALL) n USING (table_name, p)""",
    "measured_levels": f"WITH {TABLES_SQL}, " + """
      c(pattern_number, level, lower_level, upper_level) AS (VALUES """ + ", ".join(
        f"({p}::BIGINT, {l}::BIGINT, '{low}', {up})" for p, l, low, up in (
            (0, 0, "Region", "NULL"), (0, 1, "CountryName", "'Region'"), (3, 0, "CustomerName", "NULL"), (3, 1, "MarketSegment", "'CustomerName'"),
            (3, 1, "OrderStatus", "'CustomerName'"), (3, 2, "SalesChannel", "'MarketSegment'"), (3, 2, "SalesChannel", "'OrderStatus'"))) + "), m AS (" + " UNION ALL ".join(
        f"""SELECT '{u}' AS upper_level, '{w}' AS lower_level, count(*) AS lower_values, count(*) FILTER (n > 1) AS ambiguous_values
            FROM (SELECT count(DISTINCT "{u}") AS n FROM sales GROUP BY "{w}")""" for u, w in (
            ("Region", "CountryName"), ("CustomerName", "MarketSegment"), ("CustomerName", "OrderStatus"), ("MarketSegment", "SalesChannel"), ("OrderStatus", "SalesChannel"))) + """)
      SELECT c.*, lower_values, ambiguous_values, round(1 - ambiguous_values / lower_values, 4) AS dependent_share, ambiguous_values = 0 AS is_dependent
      FROM c LEFT JOIN m USING (upper_level, lower_level)""",
    "level_dependency": f"WITH {TABLES_SQL} " + " UNION ALL ".join(
        f"""SELECT '{u}' AS upper_level, '{w}' AS lower_level, count(*) AS lower_values, count(*) FILTER (n > 1) AS ambiguous_values
            FROM (SELECT count(DISTINCT "{u}") AS n FROM sales GROUP BY "{w}")""" for u, w in (("Region", "CountryName"), ("CountryName", "CustomerName"), ("CustomerName", "OrderStatus"))),
    "glossary": f"""
      WITH {FOUND}, g AS (
        SELECT table_name, 'KPI' AS term_type, kpi_name AS name, business_description AS business_definition, source_column AS source_columns,
          array_to_string(dimensions, '|') AS dimensions_used, date_column AS date_grain, kpi_confidence AS confidence FROM kpis
        UNION ALL SELECT table_name, 'DIMENSION', business_name, reason, source_column, '', 'not_applicable', confidence FROM found WHERE entity_type = 'DIMENSION'
        UNION ALL SELECT table_name, 'HIERARCHY', business_name, '{fixed.HIERARCHY_REASON}', source_column, '', 'not_applicable', 0.72 FROM hier)
      SELECT *, '{fixed.GLOSSARY_OWNER}' AS owner FROM g""",
    "reconciliation_rules": f"WITH {FOUND} SELECT *, 'absolute_or_percentage_variance' AS comparison_type, '0.01%' AS tolerance FROM rules",
    "rules_by_metric": f"""
      WITH {FOUND} SELECT table_name, metric_name, count(*) AS total_checks, bool_or(dimension IS NULL) AS has_total_check, count(*) FILTER (date_grain = 'month') AS date_check_count,
        count(*) FILTER (dimension IS NOT NULL AND date_grain <> 'month') AS dimension_check_count, '0.01%' AS tolerance FROM rules GROUP BY 1, 2""",
    "readiness": f"""
      WITH {FOUND}, parts AS (
        SELECT DISTINCT table_name, 'd' AS part, 10 AS pts FROM found WHERE entity_type = 'DIMENSION' UNION SELECT table_name, 'k', 15 FROM kpis
        UNION SELECT table_name, 'h', 10 FROM hier UNION SELECT table_name, 'r', 15 FROM rules UNION SELECT 'sales', 'a', 10)
      SELECT table_name, least(40 + sum(pts), 100)::BIGINT AS readiness_score, count(*) AS parts_present FROM parts GROUP BY 1""",
    "layered_lineage": f"WITH {FOUND}, t AS (SELECT DISTINCT table_name FROM found), lv AS (SELECT table_name, source_column, unnest(string_split(target_column, ' > ')) AS level FROM hier), sl AS (SELECT table_name, kpi_name, unnest(dimensions) AS d FROM kpis), e AS ("
        + " UNION ALL ".join(_EDGE.format(a=a, b=b, l=label, f=f) for a, b, label, f in (
            ("'source'", "'bronze_table'", "ingested as", "t"), ("'bronze_table'", "'silver_table'", "modeled in", "t"), ("'silver_table'", "'gold_kpi'", "aggregated into", "t"),
            ("'source'", "lower(entity_type) || '_' || target_column", "provides field", "found WHERE entity_type IN ('DIMENSION', 'MEASURE')"),
            ("lower(entity_type) || '_' || target_column", "'silver_table'", "modeled in", "found WHERE entity_type IN ('DIMENSION', 'MEASURE')"),
            ("'silver_table'", "'hierarchy_' || " + snake_sql("source_column"), "defines hierarchy", "hier"),
            ("'dimension_' || level", "'hierarchy_' || " + snake_sql("source_column"), "hierarchy level", "lv"),
            ("'gold_kpi'", "'kpi_' || " + snake_sql("kpi_name"), "aggregated into", "kpis"),
            ("'measure_' || s", "'kpi_' || " + snake_sql("kpi_name"), "feeds KPI", "kpis"),
            ("'dimension_' || d", "'kpi_' || " + snake_sql("kpi_name"), "slices KPI", "sl")))
        + ") SELECT DISTINCT * FROM e",
    "business_domain": f"""
      WITH {FOUND}, w AS (SELECT table_name, position, unnest(string_split(target_column, '_')) AS word, generate_subscripts(string_split(target_column, '_'), 1) AS i
        FROM found WHERE entity_type = 'MEASURE'),
      d AS (SELECT table_name, first(word ORDER BY position, i) AS domain FROM w
        WHERE word NOT IN ({_quoted(fixed.DOMAIN_STOP_TOKENS)}) GROUP BY 1)
      SELECT table_name, domain, 'silver.fact_' || domain AS silver_table, 'gold.' || domain || '_kpis' AS gold_table FROM d""",
}
