"""Queries for reconciliation (R*, U5, A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload.operators import combine, reconcile
from ferryload.plans.tables import Tables, exact_mean


def _sides(t: Tables):
    """Orders as source; the target lost some rows, all rows of one month, and has slightly different prices."""
    source = t.orders.select(
        "o_orderkey", "o_totalprice", "o_orderdate", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")
    )
    target = source.where((F.col("o_orderkey") % 500 != 0) & (F.date_format("o_orderdate", "yyyyMM") != "199705")).withColumn(
        "o_totalprice", F.when(F.col("priority") == "1-URGENT", F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    )
    return source, target


METRICS = ["total_price", "mean_price", "orders"]


def _metrics():
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return {"total_price": exact, "mean_price": exact_mean("o_totalprice"), "orders": F.count("o_totalprice")}


def _shaped(df):
    rounded = [F.round(c, 6).alias(c) for c in ("absolute_variance", "percentage_variance")]
    return df.select(*[c for c in df.columns if not c.endswith("_variance")], *rounded)


def reconcile_total(t: Tables):
    return _shaped(reconcile.compare(*_sides(t), _metrics()))


def reconcile_month(t: Tables):
    return _shaped(reconcile.compare_by_month(*_sides(t), _metrics(), "o_orderdate"))


def reconcile_dim(t: Tables):
    return _shaped(reconcile.compare_by_dimension(*_sides(t), _metrics(), "priority"))


def dimension_breakdown(t: Tables):
    rows = t.lineitem.withColumn("quantity", F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))).withColumn("price", F.col("l_extendedprice"))
    return reconcile.breakdown(rows, "l_returnflag", ["quantity", "price"]).withColumn("price", F.round("price", 2))


def expected_totals(t: Tables):
    totals = combine.metric_rows(t.lineitem, ["l_quantity", "l_tax", "l_linenumber"])
    known = t.lineitem.agg(F.sum("l_quantity").alias("l_quantity"), (F.sum("l_linenumber") + 2).cast("double").alias("l_linenumber")).unpivot(
        [], ["l_quantity", "l_linenumber"], "metric_name", "expected_total"
    )
    return reconcile.expected_totals(totals.withColumn("metric_total", F.round("metric_total", 2)), known)


QUERIES = {f.__name__: f for f in (reconcile_total, reconcile_month, reconcile_dim, dimension_breakdown, expected_totals)}

SIDES = """
s AS (SELECT o_orderkey, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
t AS (SELECT * REPLACE (CASE WHEN priority = '1-URGENT' THEN o_totalprice + 0.01 ELSE o_totalprice END AS o_totalprice) FROM s
      WHERE o_orderkey % 500 <> 0 AND strftime(o_orderdate, '%Y%m') <> '199705')"""


def compare_sql(grain: str = "", alias: str = "") -> str:
    """Both sides aggregated, joined on the grain and turned into one row per metric."""
    keys, group = (f"{grain} AS g, ", " GROUP BY 1") if grain else ("1 AS g, ", "")
    side = "SELECT {k}CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price, CAST(count(o_totalprice) AS DOUBLE) AS orders FROM {f}{g}"
    out = f"coalesce(a.g, b.g) AS {alias}, " if grain else ""
    rows = " UNION ALL ".join(
        f"SELECT {out}'{m}' AS metric_name, a.{m} AS source_value, b.{m} AS target_value FROM a FULL JOIN b ON a.g IS NOT DISTINCT FROM b.g" for m in METRICS)
    return f"""
      WITH {SIDES}, a AS ({side.format(k=keys, f='s', g=group)}), b AS ({side.format(k=keys, f='t', g=group)}), r AS ({rows})
      SELECT *, round(target_value - source_value, 6) AS absolute_variance,
        round((target_value - source_value) / nullif(source_value, 0), 6) AS percentage_variance,
        CASE WHEN source_value IS NOT DISTINCT FROM target_value OR abs((target_value - source_value) / nullif(source_value, 0)) <= 0.0001
             THEN 'passed' ELSE 'failed' END AS status FROM r"""


ORACLE = {
    "reconcile_total": compare_sql(),
    "reconcile_month": compare_sql("m", "reconciliation_month"),
    "reconcile_dim": compare_sql("priority", "priority"),
    "dimension_breakdown": """
      SELECT l_returnflag AS dimension_value, count(*) AS row_count, sum(CASE WHEN l_linenumber > 1 THEN l_quantity ELSE 0 END) AS quantity,
        round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1""",
    "expected_totals": """
      WITH f AS (SELECT sum(l_quantity) AS q, round(sum(l_tax), 2) AS x, CAST(sum(l_linenumber) AS DOUBLE) AS n FROM lineitem)
      SELECT 'l_quantity' AS metric_name, q AS metric_total, q AS expected_total, 0.0::DOUBLE AS difference, 'passed' AS status FROM f
      UNION ALL SELECT 'l_tax', x, NULL, NULL, 'pending' FROM f UNION ALL SELECT 'l_linenumber', n, n + 2, -2.0::DOUBLE, 'failed' FROM f""",
}
