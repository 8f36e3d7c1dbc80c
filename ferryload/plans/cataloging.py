"""Queries for catalogue, association, cycle, expression and lineage tables (G*, J13, Q17, T17, K5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryload.fixed_values import ASSOCIATION_STOP_FIELDS
from ferryload.functions import classes
from ferryload.functions import text as X
from ferryload.operators import catalog, checks, conversion
from ferryload.plans.loading import snake_sql
from ferryload.plans.tables import Tables, plain_name

MODEL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def page_fields(t: Tables):
    """Field catalogue of the pages: an app per top-level domain, a table per page, a field per navigation link."""
    labels = F.regexp_extract_all("html", F.lit('<li><a href="/([^"<&]*)"'), F.lit(1))
    rows = t.pages.select(
        F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("app_id"), F.concat(F.lit("page_"), "page_id").alias("table_name"),
        "page_id", F.posexplode(labels).alias("position", "field_name"),
    )
    return catalog.with_key_flag(rows)


def model_fields(t: Tables):
    """Field catalogue of the given tables with their measured row counts."""
    listed = t.spark.createDataFrame(
        [("m", name, i, plain_name(c)) for name in MODEL_TABLES for i, c in enumerate(getattr(t, name).columns)],
        "app_id string, table_name string, position int, field_name string",
    )
    sizes = catalog.table_sizes(**{name: getattr(t, name) for name in MODEL_TABLES})
    return catalog.with_key_flag(listed.join(sizes, "table_name", "left"))


def field_associations(t: Tables):
    return catalog.associations(page_fields(t))


def model_associations(t: Tables):
    """Tables and occurrences per shared field."""
    return catalog.associations(page_fields(t)).groupBy("app_id", "field").agg(
        F.max("table_count").alias("tables"), F.sum("occurrences").alias("occurrences"), F.min("hub_table").alias("hub_table"),
        F.count_if(F.col("side") == "many").alias("many_sides"),
    )


def marked_fields(t: Tables):
    """Page fields with every field of five or more letters marked as a link field."""
    long = F.length("field_name") >= 5
    return page_fields(t).withColumn("field_name", F.when(long, F.concat(F.lit("%"), "field_name")).otherwise(F.col("field_name"))).withColumn("is_key", long)


def synthetic_keys(t: Tables):
    return catalog.synthetic_keys(marked_fields(t))


def composite_keys(t: Tables):
    return catalog.composite_keys(marked_fields(t))


def table_roles(t: Tables):
    fields = model_fields(t)
    return catalog.table_roles(fields.drop("row_count"), fields.groupBy("app_id", "table_name").agg(F.max("row_count").alias("row_count"))).drop("app_id")


def field_registry(t: Tables):
    return catalog.field_registry(page_fields(t))


def field_statistics(t: Tables):
    return catalog.field_statistics(page_fields(t))


def key_flags(t: Tables):
    return page_fields(t).groupBy("app_id", "is_key").agg(F.count("*").alias("fields"))


def date_storage(t: Tables):
    fields = page_fields(t)
    return conversion.date_storage_registry(fields, fields.where("position = 1").select("table_name", "field_name"))


def island_tables(t: Tables):
    return checks.island_tables(page_fields(t), F.col("page_id") % 10 == 0)


def business_names(t: Tables):
    raw = F.concat("p_type", F.lit("_"), F.translate("p_name", " ", "-"), F.lit("."), "p_brand")
    measure = F.concat(F.lit("%lf_"), F.translate("p_name", " ", "_"), F.when(F.col("p_size") > 25, "_budget_qty").otherwise("_mth_yoy"))
    return t.part.select("p_partkey", X.business_name(raw).alias("business_name"), X.display_name(measure).alias("display_name"))


# --- cycles ----------------------------------------------------------------------

def trade_edges(t: Tables) -> DataFrame:
    """Net flow of goods between nations, from the supplier's to the customer's nation."""
    lines = t.plain("lineitem").select("orderkey", "suppkey", "extendedprice")
    buyers = t.plain("orders").select("orderkey", "custkey").join(
        t.plain("customer").select("custkey", F.col("nationkey").alias("b")), "custkey"
    )
    sellers = t.plain("supplier").select("suppkey", F.col("nationkey").alias("a"))
    flows = lines.join(sellers, "suppkey").join(buyers.select("orderkey", "b"), "orderkey").where("a <> b")
    sign = F.when(F.col("a") < F.col("b"), F.col("extendedprice")).otherwise(-F.col("extendedprice"))
    net = flows.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.round(F.sum(sign), 2).alias("net"))
    return net.where("net <> 0").select(
        F.when(F.col("net") > 0, F.col("low")).otherwise(F.col("high")).alias("src"),
        F.when(F.col("net") > 0, F.col("high")).otherwise(F.col("low")).alias("dst"),
    )


def trade_cycles(t: Tables):
    return catalog.circular_relationships(trade_edges(t))


def label_edges(t: Tables) -> DataFrame:
    """A link from each navigation label to the next one of its page."""
    labels = F.regexp_extract_all("html", F.lit('<li><a href="/([^"<&]*)"'), F.lit(1))
    rows = t.pages.select(F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("app_id"), labels.alias("l")).where(F.size("l") > 1)
    pairs = F.transform(F.slice("l", 2, F.size("l")), lambda name, i: F.struct(F.element_at("l", i + 1).alias("src"), name.alias("dst")))
    return rows.select("app_id", F.explode(pairs).alias("e")).select("app_id", "e.src", "e.dst")


def label_cycles(t: Tables):
    return catalog.circular_relationships(label_edges(t)).groupBy("app_id", "src", "dst").agg(
        F.count("*").alias("links"), F.bool_or("is_circular").alias("is_circular")
    )


# --- expressions --------------------------------------------------------------------

EXPRESSIONS = [
    "concat('Sum({<p_brand={', p_brand, '}>} [p_retailprice])')", "concat('If(p_size > ', p_size, ', Sum(p_retailprice), 0)')",
    "concat('RGB(p_size, ', p_size, ', 0)')", "concat('Avg([p_', split(p_name, ' ')[1], ']) / Count(p_partkey)')",
    "concat('Max(Sales Amount) + ', p_size)", "concat(p_name, ' & p_type & ', p_type, '[Unknown Field]')",
]


def expressions(t: Tables) -> DataFrame:
    """A chart expression per part, written from the part's own values."""
    chosen = reduce(lambda acc, i: acc.when(F.col("p_size") % 6 == i, F.expr(EXPRESSIONS[i])), range(1, 6), F.when(F.col("p_size") % 6 == 0, F.expr(EXPRESSIONS[0])))
    return t.part.select(
        F.col("p_partkey").alias("expression_id"), F.col("p_partkey").alias("object_id"), F.lit("meas").alias("object_type"), "p_brand", "p_size",
        F.concat(F.col("p_size") % 3, F.lit("")).alias("context_id"), F.lit("measure_expression").alias("expression_type"),
        F.col("p_partkey").alias("position"), chosen.alias("expression"),
    )


def expression_targets(t: Tables) -> DataFrame:
    """Fields the expressions may name: the part columns, a two-word field, and words of the part names."""
    words = t.part.select(F.concat(F.lit("p_"), F.split("p_name", " ")[1]).alias("field_name"), F.lit("words").alias("table_name")).distinct()
    columns = t.spark.createDataFrame([(c, "part") for c in [*t.part.columns, "Sales Amount"]], "field_name string, table_name string")
    return columns.unionByName(words)


def expression_fields(t: Tables):
    return catalog.expression_fields(expressions(t), expression_targets(t))


def expression_classes(t: Tables):
    parts = catalog.expression_class_counts(expressions(t), "p_brand")
    talk = catalog.expression_class_counts(t.documents.select(F.col("text").alias("expression"), F.col("lang").alias("p_brand")), "p_brand")
    return parts.unionByName(talk)


def expression_aggregates(t: Tables):
    return expressions(t).select("expression_id", classes.aggregate_name(F.col("expression")).alias("aggregate"))


def distinct_expressions(t: Tables):
    return catalog.distinct_expressions(expressions(t)).select("position", "context_id", "expression", "classification")


def lineage_edges(t: Tables):
    uses = t.part.select(
        F.concat(F.lit("viz_"), "p_brand").alias("source"), F.concat(F.lit("meas_"), F.col("p_partkey") + 7).alias("target"), F.lit("uses_measure").alias("edge_type")
    )
    return catalog.lineage_edges(expressions(t), expression_targets(t), uses)


def broken_references(t: Tables):
    measures = t.part.select(F.concat(F.lit("meas_"), "p_partkey").alias("node_id"))
    visuals = t.part.select(F.concat(F.lit("viz_"), "p_brand").alias("node_id")).where("node_id <> 'viz_Brand#3'").distinct()
    fields = expression_targets(t).where("field_name <> 'p_size'").select(F.concat(F.lit("fld_"), "table_name", F.lit("."), "field_name").alias("node_id")).distinct()
    tables = t.spark.createDataFrame([("tbl_part",)], "node_id string")
    return catalog.broken_references(lineage_edges(t), measures.unionByName(visuals).unionByName(fields).unionByName(tables))


def duplicate_ids(t: Tables):
    ids = t.documents.select(F.lit("app").alias("app_id"), F.col("doc_id").alias("object_id")).unionByName(
        t.labels.select(F.lit("app").alias("app_id"), F.col("doc_id").alias("object_id"))
    )
    return catalog.duplicate_ids(ids)


def completeness(t: Tables):
    kinds = ["tables", "fields", "variables", "dimensions", "measures", "visualizations", "sheets", "stories", "loadScript", "appMetadata", "rawObjects", "expressions"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("n_chars") % len(kinds) + 1).cast("int"))
    objects = t.documents.select(F.col("source").alias("app_id"), kind.alias("object_type"), F.concat(F.lit("o"), F.col("doc_id") % 800).alias("object_id"))
    edges = t.documents.select(
        F.col("source").alias("app_id"), F.concat(F.lit("o"), F.col("doc_id") % 800).alias("source"),
        F.concat(F.lit("o"), F.when(F.col("n_chars") % 9 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")) % 800).alias("target"),
    )
    return catalog.completeness(objects, edges).select(
        "app_id", *[F.col(c).cast("bigint").alias(c) for c in ("kinds_present", "duplicate_ids", "broken_ends", "completeness_score")]
    )


QUERIES = {f.__name__: f for f in (
    field_associations, model_associations, synthetic_keys, composite_keys, table_roles, field_registry, field_statistics, key_flags,
    date_storage, island_tables, business_names, trade_cycles, label_cycles, expression_fields, expression_classes, expression_aggregates,
    distinct_expressions, lineage_edges, broken_references, duplicate_ids, completeness,
)}

PAGE_FIELDS = """
f AS (
  SELECT regexp_extract(url, 'example\\.([a-z]+)', 1) AS app_id, 'page_' || page_id AS table_name, page_id, u.i AS position, u.name AS field_name,
    lower(u.name) AS field, regexp_matches(lower(u.name), '(id|key)$|^%') AS is_key
  FROM pages, LATERAL (SELECT unnest(l) AS name, unnest(range(0, len(l))) AS i FROM (SELECT regexp_extract_all(html, '<li><a href="/([^"<&]*)"', 1) AS l)) u)"""
STOP = ", ".join(f"'{name}'" for name in ASSOCIATION_STOP_FIELDS)
LINKS = f"""
uses AS (SELECT app_id, field, table_name, min(field_name) AS field_name, count(*) AS occurrences FROM f WHERE field <> '' AND (is_key OR field NOT IN ({STOP})) GROUP BY 1, 2, 3),
links AS (SELECT *, count(*) OVER (PARTITION BY app_id, field) AS table_count, min(table_name) OVER (PARTITION BY app_id, field) AS hub_table,
  CASE WHEN occurrences = 1 THEN 'one' ELSE 'many' END AS side FROM uses QUALIFY table_count > 1)"""
MARKED = """
m AS (SELECT app_id, table_name, position, '%' || lower(field_name) AS field, '%' || field_name AS field_name FROM f WHERE length(field_name) >= 5)"""
_MODEL_COLUMNS = {
    "region": "regionkey name", "nation": "nationkey name regionkey", "customer": "custkey name nationkey acctbal mktsegment",
    "supplier": "suppkey name nationkey acctbal", "part": "partkey name brand type size retailprice",
    "orders": "orderkey custkey orderstatus totalprice orderdate orderpriority",
    "lineitem": "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate",
}
MODEL = "listed(table_name, position, field_name) AS (VALUES " + ", ".join(
    f"('{t}', {i}, '{c}')" for t, cs in _MODEL_COLUMNS.items() for i, c in enumerate(cs.split())) + "), sizes AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _MODEL_COLUMNS) + """),
f AS (SELECT 'm' AS app_id, *, lower(field_name) AS field, regexp_matches(field_name, '(id|key)$|^%') AS is_key FROM listed JOIN sizes USING (table_name))"""
TRADE = """
flow AS (
  SELECT least(s_nationkey, c_nationkey) AS low, greatest(s_nationkey, c_nationkey) AS high,
    round(sum(CASE WHEN s_nationkey < c_nationkey THEN l_extendedprice ELSE -l_extendedprice END), 2) AS net
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL HAVING net <> 0),
edges AS (SELECT CAST(CASE WHEN net > 0 THEN low ELSE high END AS VARCHAR) AS src, CAST(CASE WHEN net > 0 THEN high ELSE low END AS VARCHAR) AS dst FROM flow)"""
REACH = "reach AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst UNION SELECT reach.src, edges.dst FROM reach JOIN edges ON reach.dst = edges.src)"
EXPR = """
e AS (SELECT p_partkey AS expression_id, p_brand, p_size, CAST(p_size % 3 AS VARCHAR) AS context_id, p_partkey AS position, string_split(p_name, ' ')[2] AS word, p_name, p_type,
  CASE p_size % 6 WHEN 0 THEN 'Sum({<p_brand={' || p_brand || '}>} [p_retailprice])' WHEN 1 THEN 'If(p_size > ' || p_size || ', Sum(p_retailprice), 0)'
    WHEN 2 THEN 'RGB(p_size, ' || p_size || ', 0)' WHEN 3 THEN 'Avg([p_' || string_split(p_name, ' ')[2] || ']) / Count(p_partkey)'
    WHEN 4 THEN 'Max(Sales Amount) + ' || p_size ELSE p_name || ' & p_type & ' || p_type || '[Unknown Field]' END AS expression FROM part),
refs AS (
  SELECT expression_id, unnest(CASE p_size % 6 WHEN 0 THEN ['p_brand', 'p_retailprice'] WHEN 1 THEN ['p_size', 'p_retailprice'] WHEN 2 THEN ['p_size']
    WHEN 3 THEN ['p_' || word, 'p_partkey'] WHEN 4 THEN ['Sales Amount'] ELSE ['p_type'] END) AS field_name FROM e),
targets AS (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice', 'Sales Amount']) AS field_name, 'part' AS table_name
  UNION ALL SELECT DISTINCT 'p_' || word, 'words' FROM e)"""
CLASS = """CASE WHEN contains(x, '{<') THEN 'set_analysis' WHEN regexp_matches(lower(x), 'if\\(|pick\\(|match\\(') THEN 'conditional'
  WHEN regexp_matches(lower(x), 'rgb\\(|color\\(') THEN 'color' WHEN regexp_matches(lower(x), '(sum|count|avg|min|max|only|concat)\\(') THEN 'aggregation' ELSE 'expression' END"""
LINEAGE = EXPR + """,
edges AS (
  SELECT 'meas_' || expression_id AS source, 'fld_' || table_name || '.' || field_name AS target, 'uses_field' AS edge_type FROM refs JOIN targets USING (field_name)
  UNION ALL SELECT 'meas_' || expression_id, 'fld_Unknown Field', 'uses_field' FROM e WHERE p_size % 6 = 5
  UNION ALL SELECT 'fld_' || table_name || '.' || field_name, 'tbl_' || table_name, 'belongs_to_table' FROM targets
  UNION ALL SELECT 'viz_' || p_brand, 'meas_' || (p_partkey + 7), 'uses_measure' FROM part)"""

ORACLE = {
    "field_associations": f"WITH {PAGE_FIELDS}, {LINKS} SELECT * FROM links",
    "model_associations": f"""
      WITH {PAGE_FIELDS}, {LINKS} SELECT app_id, field, max(table_count) AS tables, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(hub_table) AS hub_table,
        count(*) FILTER (side = 'many') AS many_sides FROM links GROUP BY 1, 2""",
    "synthetic_keys": f"""
      WITH {PAGE_FIELDS}, {MARKED}, u AS (SELECT DISTINCT app_id, field, table_name FROM m),
      s AS (SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY app_id, field) > 1),
      c AS (SELECT app_id, table_name, string_agg(field, ', ' ORDER BY field) AS shared_fields, count(*) AS field_count FROM s GROUP BY 1, 2)
      SELECT *, count(*) OVER (PARTITION BY app_id, shared_fields) AS table_count, 'synthetic_key' AS relationship FROM c""",
    "composite_keys": f"""
      WITH {PAGE_FIELDS}, {MARKED} SELECT app_id, table_name, count(*) AS key_count, string_agg(field_name, ', ' ORDER BY position) AS key_fields, 'composite_key' AS relationship
      FROM m GROUP BY 1, 2 HAVING count(*) > 1""",
    "table_roles": f"""
      WITH {MODEL}, k AS (SELECT table_name, count(*) FILTER (is_key) AS key_count, count(*) FILTER (NOT is_key) AS other_count, max(row_count) AS row_count FROM f GROUP BY 1)
      SELECT *, CASE WHEN key_count >= 2 AND other_count <= 1 THEN 'bridge' WHEN key_count >= 3 THEN 'fact' ELSE 'dimension' END AS table_role FROM k""",
    "field_registry": f"""
      WITH {PAGE_FIELDS}, d AS (SELECT DISTINCT app_id, field, table_name FROM f) SELECT *, count(*) OVER (PARTITION BY app_id, field) AS table_count FROM d""",
    "field_statistics": f"""
      WITH {PAGE_FIELDS} SELECT app_id, table_name, count(*) AS field_count, count(*) FILTER (is_key) AS key_count,
        CASE WHEN count(*) FILTER (is_key) > 1 THEN 'fact' ELSE 'dimension' END AS node_type FROM f GROUP BY 1, 2""",
    "key_flags": f"WITH {PAGE_FIELDS} SELECT app_id, is_key, count(*) AS fields FROM f GROUP BY 1, 2",
    "date_storage": f"""
      WITH {PAGE_FIELDS}, s AS (SELECT DISTINCT table_name, field FROM f WHERE position = 1),
      c AS (SELECT f.field, CASE WHEN regexp_matches(f.field, '\\byyyymm\\b') THEN 'integer_yyyymm' WHEN s.field IS NOT NULL THEN 'unknown'
        WHEN regexp_matches(f.field, '(date|_dt|_at|timestamp|yyyymm|orderdate|createddate|modifieddate)$') THEN 'date' ELSE 'unknown' END AS st
        FROM f LEFT JOIN s ON f.table_name = s.table_name AND f.field = s.field)
      SELECT field AS field_name, min(st) AS storage_type, count(*) AS uses, count(*) FILTER (st = 'unknown') AS ambiguous_uses, min(st) <> max(st) AS is_inconsistent FROM c GROUP BY 1""",
    "island_tables": f"""
      WITH {PAGE_FIELDS} SELECT DISTINCT app_id, table_name FROM f WHERE page_id % 10 <> 0
        AND table_name NOT IN (SELECT a.table_name FROM f a JOIN f b ON a.field = b.field AND a.app_id = b.app_id WHERE b.page_id % 10 = 0)""",
    "business_names": f"""
      WITH n AS (SELECT p_partkey, regexp_extract_all(lower(replace(replace(p_type || ' ' || p_name || ' ' || p_brand, '-', ' '), '.', ' ')), '[a-z]+|[^a-z]+') AS runs,
          '%lf_' || replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '_budget_qty' ELSE '_mth_yoy' END AS m FROM part),
      s AS (SELECT *, {snake_sql('m')} AS sn FROM n)
      SELECT p_partkey, array_to_string(list_transform(runs, lambda r: upper(r[1]) || r[2:]), '') AS business_name,
        array_to_string(list_transform(string_split(sn, '_'), lambda w: CASE WHEN w = 'lf' AND contains(m, 'budget') THEN 'Latest Forecast' WHEN w = 'mth' THEN 'Month'
          WHEN w = 'yoy' THEN 'YoY' WHEN w = 'qty' THEN 'Quantity' ELSE upper(w[1]) || w[2:] END), ' ') AS display_name FROM s""",
    "trade_cycles": f"""
      WITH RECURSIVE {TRADE}, {REACH}
      SELECT src, dst, EXISTS (SELECT 1 FROM reach r WHERE r.src = edges.dst AND r.dst = edges.src) AS is_circular FROM edges""",
    "label_cycles": f"""
      WITH RECURSIVE {PAGE_FIELDS}, edges AS (SELECT * FROM (SELECT app_id, field_name AS src, lead(field_name) OVER (PARTITION BY table_name ORDER BY position) AS dst FROM f) WHERE dst IS NOT NULL),
      steps AS (SELECT DISTINCT app_id, src, dst FROM edges WHERE src <> dst),
      reach AS (SELECT app_id, src, dst FROM steps UNION SELECT reach.app_id, reach.src, steps.dst FROM reach JOIN steps ON reach.dst = steps.src AND reach.app_id = steps.app_id)
      SELECT e.app_id, e.src, e.dst, count(*) AS links, bool_or(r.src IS NOT NULL) AS is_circular FROM edges e
      LEFT JOIN reach r ON r.app_id = e.app_id AND r.src = e.dst AND r.dst = e.src GROUP BY 1, 2, 3""",
    "expression_fields": f"""
      WITH {EXPR} SELECT expression_id, field_name, true AS is_known FROM refs UNION ALL SELECT expression_id, 'Unknown Field', false FROM e WHERE p_size % 6 = 5""",
    "expression_classes": f"""
      WITH {EXPR}, a AS (SELECT p_brand, expression AS x FROM e UNION ALL SELECT lang, text FROM documents)
      SELECT p_brand, {CLASS} AS classification, count(*) AS expressions FROM a GROUP BY 1, 2""",
    "expression_aggregates": f"""
      WITH {EXPR} SELECT expression_id, nullif(upper(regexp_extract(lower(expression), '\\b(sum|count|avg|max|min|concat|only)\\b', 1)), '') AS aggregate FROM e""",
    "distinct_expressions": f"""
      WITH {EXPR}, d AS (SELECT position, context_id, expression, expression AS x FROM e
        QUALIFY row_number() OVER (PARTITION BY lower(trim(expression)), context_id ORDER BY position) = 1)
      SELECT position, context_id, expression, {CLASS} AS classification FROM d""",
    "lineage_edges": f"WITH {LINEAGE} SELECT * FROM edges",
    "broken_references": f"""
      WITH {LINEAGE} SELECT * FROM edges
      WHERE source IN ('viz_Brand#3', 'fld_part.p_size') OR target IN ('fld_part.p_size', 'tbl_words', 'fld_Unknown Field') OR (edge_type = 'uses_measure' AND target NOT IN (SELECT 'meas_' || p_partkey FROM part))""",
    "duplicate_ids": """
      SELECT 'app' AS app_id, doc_id AS object_id, count(*) AS uses FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY 2 HAVING count(*) > 1""",
    "completeness": """
      WITH o AS (SELECT source AS app_id, n_chars % 12 AS k, 'o' || doc_id % 800 AS id FROM documents),
      e AS (SELECT source AS app_id, 'o' || doc_id % 800 AS s, 'o' || (CASE WHEN n_chars % 9 = 0 THEN doc_id + 1 ELSE doc_id END) % 800 AS t FROM documents),
      p AS (SELECT app_id, count(DISTINCT k) FILTER (k <= 9) AS kinds_present, max(CASE WHEN k = 10 THEN 5 ELSE 0 END) AS raw, max(CASE WHEN k = 8 THEN 5 ELSE 0 END) AS script FROM o GROUP BY 1),
      d AS (SELECT app_id, count(*) AS n FROM (SELECT app_id FROM o GROUP BY app_id, id HAVING count(*) > 1) GROUP BY 1),
      b AS (SELECT app_id, count(DISTINCT n) AS n FROM (SELECT app_id, s AS n FROM e UNION SELECT app_id, t FROM e) x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.app_id = x.app_id AND o.id = x.n) GROUP BY 1)
      SELECT p.app_id, kinds_present, coalesce(d.n, 0) AS duplicate_ids, coalesce(b.n, 0) AS broken_ends,
        CAST(least(kinds_present * 10 + CASE WHEN d.n IS NULL THEN 5 ELSE 0 END + CASE WHEN b.n IS NULL THEN 5 ELSE 0 END + raw + script, 100) AS BIGINT) AS completeness_score
      FROM p LEFT JOIN d ON p.app_id = d.app_id LEFT JOIN b ON p.app_id = b.app_id""",
}
