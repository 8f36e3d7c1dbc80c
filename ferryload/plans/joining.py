"""Queries for joins and aggregates (J*, A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryload.functions import aggregates as A
from ferryload.functions import dates as D
from ferryload.functions import numbers as N
from ferryload.operators import combine as U
from ferryload.operators import grouping as G
from ferryload.operators import joins as J
from ferryload.plans.tables import Tables, exact_mean


def month_region_sales(t: Tables):
    """The flagship: lines with orders, customers and places, summed per month-region key.

    Lines are summed per order before any join and places are looked up on the customers,
    so the large table is shuffled once and only one row per order goes on from there.
    """
    net = F.col("extendedprice") * (1 - F.col("discount"))
    per_order = t.plain("lineitem").groupBy("orderkey").agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("quantity"), F.sum(net).alias("net_sales")
    )
    places = t.plain("customer").select("custkey", "nationkey")
    for table in (t.plain("nation").select("nationkey", "regionkey"), t.plain("region").withColumnRenamed("name", "region")):
        places = J.natural_join(places, table, "left", unique_right=True)
    orders = t.plain("orders").select("orderkey", "custkey", F.col("orderdate").cast("date").alias("orderdate"))
    rows = J.natural_join(J.natural_join(per_order, orders, "left", unique_right=True), places, "left", unique_right=True)
    key = D.month_region_key(F.col("region"), F.col("orderdate"), 12)
    return rows.groupBy(key.alias("month_region_key")).agg(
        F.sum("line_count").alias("line_count"), F.sum("quantity").alias("sum_quantity"), F.round(F.sum("net_sales"), 4).alias("net_sales"),
    ).orderBy("month_region_key")


def _customer(t: Tables):
    return t.plain("customer").select("custkey", F.col("name").alias("customer"), "mktsegment")


def _some_orders(t: Tables):
    """All orders; every seventh customer's orders name a customer that does not exist, so both sides keep unmatched rows."""
    shifted = F.when(F.col("custkey") % 7 == 0, -F.col("custkey")).otherwise(F.col("custkey"))
    return t.plain("orders").select("orderkey", shifted.alias("custkey"), "totalprice")


def natural_left_join(t: Tables):
    return J.natural_join(_customer(t), _some_orders(t), "left")


def join_inner(t: Tables):
    return J.natural_join(_customer(t), _some_orders(t), "inner")


def join_right(t: Tables):
    return J.natural_join(_customer(t), _some_orders(t), "right")


def join_full(t: Tables):
    return J.natural_join(_customer(t), _some_orders(t), "full")


def single_row_attach(t: Tables):
    top = t.orders.agg(F.max("o_totalprice").alias("max_price"), F.count("*").alias("order_count"))
    return J.attach_single_row(t.nation.select("n_name"), top)


def keep_left(t: Tables):
    kept, _ = J.keep(_customer(t), _some_orders(t), "left")
    return kept


def keep_inner(t: Tables):
    customers, orders = J.keep(_customer(t), _some_orders(t), "inner")
    rows = lambda df, name: df.groupBy(F.lit(name).alias("table_name")).agg(F.count("*").alias("rows"), F.count_distinct("custkey").alias("keys"))
    return rows(customers, "customers").unionByName(rows(orders, "orders"))


def keep_right(t: Tables):
    _, orders = J.keep(_customer(t), _some_orders(t), "right")
    return orders


def two_nations(t: Tables):
    """One dimension reached twice: the customer's and the supplier's nation of each order line."""
    fact = t.plain("lineitem").select("orderkey", "suppkey", "quantity")
    orders = t.plain("orders").select("orderkey", "custkey")
    nations = t.plain("nation").select("nationkey", "name")
    model, _ = J.star_join(fact, {
        "ord": (orders, ["ORDERKEY"]), "cust": (t.plain("customer").select("custkey", "nationkey"), ["custkey"]),
        "supp": (t.plain("supplier").select("suppkey", "nationkey"), ["suppkey"]),
        "buyer": (nations, {"cust.nationkey": "nationkey"}), "seller": (nations, {"supp.nationkey": "nationkey"}),
    })
    return model.groupBy("buyer_name", "seller_name").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


def exists_flag(t: Tables):
    return J.exists_flag(_customer(t).select("custkey"), "custkey", _some_orders(t), "custkey", "has_order")


def star_model(t: Tables):
    fact = t.plain("lineitem").select("orderkey", "partkey", "suppkey", "linenumber", "quantity")
    model, left_out = J.star_join(fact, {
        "cust": (t.plain("customer"), ["custkey"]),
        "nat": (t.plain("nation"), ["nationkey"]),
        "ord": (t.plain("orders").select("orderkey", "custkey", "orderpriority"), ["orderkey"]),
        "part": (t.plain("part").select("partkey", "brand", "type"), ["partkey"]),
        "reg": (t.plain("region"), ["regionkey"]),
        "lab": (t.labels, ["doc_id"]),
    })
    return model.groupBy("reg_name", "part_type", "ord_orderpriority", F.lit(",".join(left_out)).alias("left_out")).agg(
        F.count("*").alias("line_count"), F.sum("quantity").alias("quantity"), F.count_distinct("custkey").alias("customers"),
    )


def star_model_checked(t: Tables):
    fact = t.plain("orders").select("orderkey", "custkey", "totalprice")
    model, left_out = J.star_join(fact, {
        "cust": (t.plain("customer").select("custkey", "nationkey", "mktsegment"), ["custkey"]),
        "supp": (t.plain("supplier").select("nationkey", "suppkey"), ["nationkey"]),
        "line": (t.plain("lineitem").select("orderkey", "quantity"), ["orderkey"]),
        "nat": (t.plain("nation").select("nationkey", "name"), ["nationkey"]),
    }, verify=True)
    return model.groupBy("cust_mktsegment", "nat_name", F.lit(",".join(left_out)).alias("left_out")).agg(
        F.count("*").alias("orders"), F.round(F.sum("totalprice"), 2).alias("total_price")
    )


def enrich_projection(t: Tables):
    fact = t.plain("orders").select("orderkey", "custkey", F.col("totalprice").alias("acctbal"))
    customers = t.plain("customer")
    new = U.enrichment(fact, customers, "cust", ["custkey"])
    return fact.join(customers.select("custkey", *new), "custkey", "left")


def project_aliases(t: Tables):
    named = t.customer.withColumnRenamed("c_name", "Customer Name")
    return U.project(named, {
        "Key": "c_custkey", "Customer": "[Customer Name]", "Balance Class": F.when(F.col("c_acctbal") < 0, "owes").otherwise("has"),
    })


def bridge_join(t: Tables):
    fact = t.plain("orders").select("orderkey", "custkey")
    bridge = t.plain("customer").select("custkey", "nationkey")
    nation = t.plain("nation").select("nationkey", F.col("name").alias("nation"))
    return J.bridge_join(fact, bridge, nation).groupBy("nation").agg(F.count("*").alias("orders"))


def composite_grain_join(t: Tables):
    month = F.date_format("orderdate", "yyyyMM")
    orders = t.plain("orders").select("orderkey", month.alias("yyyymm"), F.col("orderstatus").alias("account"))
    plan = t.plain("orders").groupBy(month.alias("yyyymm"), F.col("orderstatus").alias("account")).agg(
        exact_mean("totalprice").alias("plan_price")
    ).withColumn("account", F.when(F.col("account") == "F", "closed").otherwise(F.col("account")))
    return J.grain_join(orders, plan, ["yyyymm", "account"])


def aggregate_before_join(t: Tables):
    return J.aggregate_then_join(
        _customer(t).select("custkey"), _some_orders(t), ["custkey"],
        order_count=F.count("*"), order_total=F.round(F.sum("totalprice"), 2),
    )


def pivot_before_join(t: Tables):
    orders = t.plain("orders").select("custkey", "orderstatus", F.lit(1).cast("bigint").alias("n"))
    return J.pivot_then_join(_customer(t).select("custkey"), orders, ["custkey"], "orderstatus", ["F", "O", "P"], "n")


def totals_side_by_side(t: Tables):
    lines = t.lineitem.agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    orders = t.orders.agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return J.side_by_side(lines=lines, orders=orders)


def full_outer_on_grain(t: Tables):
    nation = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))
    customers = t.customer.groupBy(nation.alias("nationkey")).agg(F.count("*").alias("customers"))
    place = F.when(F.col("s_nationkey") != 3, F.col("s_nationkey"))
    place = F.when(F.col("s_nationkey") == 7, 107).otherwise(place)
    suppliers = t.supplier.groupBy(place.alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return J.full_on_grain(customers, suppliers, ["nationkey"])


def orphans(t: Tables):
    nations = t.nation.withColumn("n_nationkey", F.when(F.col("n_regionkey") == 2, -F.col("n_nationkey") - 1).otherwise(F.col("n_nationkey")))
    return J.orphans(t.supplier.select("s_suppkey", "s_nationkey"), ["s_nationkey"], nations, ["n_nationkey"])


def join_match_ratio(t: Tables):
    return J.match_ratio(_some_orders(t), "custkey", t.customer, "c_custkey")


# --- aggregates ---------------------------------------------------------------

def set_analysis_sum(t: Tables):
    chosen = {"l_returnflag": ["A", "R"], "l_linestatus": ["F"]}
    return t.lineitem.groupBy("l_linenumber").agg(
        F.round(A.set_sum(F.col("l_extendedprice"), chosen), 2).alias("selected_sum"),
        A.set_count(chosen).alias("selected_count"), F.round(F.sum("l_extendedprice"), 2).alias("full_sum"),
    )


def conditional_sum(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(
        A.sum_if(F.col("l_discount") > 0.05, F.col("l_quantity"), 0.0).alias("discounted_quantity")
    )


def only_value(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(
        A.only(F.col("l_returnflag")).alias("only_flag"), A.only(F.col("l_linestatus")).alias("only_status")
    )


def stats_aggs(t: Tables):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    names = {"stdev": [q], "variance": [q], "correl": [q, p], "covar": [q, p], "skew": [p], "kurtosis": [p], "avg": [p], "min": [p], "max": [p]}
    return t.lineitem.groupBy("l_returnflag").agg(
        *[F.round(A.statistic(n, *cols), 4).alias(n) for n, cols in names.items()]
    )


def median_per_group(t: Tables):
    return G.median(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")


def mode_per_group(t: Tables):
    return G.mode(t.lineitem, ["l_suppkey"], "l_quantity", "mode_quantity")


def concat_values(t: Tables):
    return G.concat_distinct(t.orders, ["o_orderstatus"], "o_orderpriority", "priorities", "; ")


def concat_repeats(t: Tables):
    return G.concat(t.orders, ["o_custkey"], "o_orderstatus", "statuses", "", weight="o_orderkey")


def first_last_sorted_value(t: Tables):
    by = F.col("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(
        A.first_sorted_value(F.col("o_orderkey"), by).alias("cheapest_order"),
        A.last_sorted_value(F.col("o_orderkey"), by).alias("dearest_order"),
    )


def nested_aggr(t: Tables):
    month = t.orders.select("*", F.date_format("o_orderdate", "yyyyMM").alias("yyyymm"))
    return G.nested(
        month, ["o_orderpriority", "yyyymm"], {"monthly": F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")},
        ["o_orderpriority"], {"best_month": F.max("monthly"), "mean_month": exact_mean("monthly"), "months": F.count("*")},
    )


def distinct_count(t: Tables):
    return G.distinct_count(t.lineitem, ["l_returnflag"], "l_partkey", "parts")


def guarded_ratio(t: Tables):
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0))
    closed = F.sum(F.when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 3 == 0), F.col("o_totalprice")).otherwise(0))
    return t.orders.groupBy("o_custkey").agg(F.round(N.ratio(urgent, closed), 6).alias("urgent_to_closed"))


QUERIES = {f.__name__: f for f in (
    month_region_sales, natural_left_join, join_inner, join_right, join_full, single_row_attach, keep_left, keep_inner,
    keep_right, two_nations, exists_flag, star_model, star_model_checked, enrich_projection, project_aliases, bridge_join, composite_grain_join, aggregate_before_join, pivot_before_join,
    totals_side_by_side, full_outer_on_grain, orphans, join_match_ratio, set_analysis_sum, conditional_sum, only_value,
    stats_aggs, median_per_group, mode_per_group, concat_values, concat_repeats, first_last_sorted_value, nested_aggr, distinct_count,
    guarded_ratio,
)}

SIDES = """
c AS (SELECT c_custkey AS custkey, c_name AS customer, c_mktsegment AS mktsegment FROM customer),
o AS (SELECT o_orderkey AS orderkey, CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS custkey, o_totalprice AS totalprice FROM orders)"""

_JOIN = "WITH " + SIDES + " SELECT custkey, customer, mktsegment, orderkey, totalprice FROM c {how} JOIN o USING (custkey)"

ORACLE = {
    "month_region_sales": """
      SELECT r_name || '_' || strftime(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH, '%Y%m') AS month_region_key,
             count(*) AS line_count, sum(l_quantity) AS sum_quantity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net_sales
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
           LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
      GROUP BY 1 ORDER BY 1""",
    "natural_left_join": _JOIN.format(how="LEFT"),
    "join_inner": _JOIN.format(how="INNER"),
    "join_right": _JOIN.format(how="RIGHT"),
    "join_full": _JOIN.format(how="FULL"),
    "single_row_attach": """
      SELECT n_name, (SELECT max(o_totalprice) FROM orders) AS max_price, (SELECT count(*) FROM orders) AS order_count FROM nation""",
    "keep_left": f"WITH {SIDES} SELECT * FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.custkey = c.custkey)",
    "keep_inner": f"""
      WITH {SIDES}, kc AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.custkey = c.custkey)),
           ko AS (SELECT * FROM o WHERE EXISTS (SELECT 1 FROM c WHERE o.custkey = c.custkey))
      SELECT 'customers' AS table_name, count(*) AS "rows", count(DISTINCT custkey) AS keys FROM kc
      UNION ALL SELECT 'orders', count(*), count(DISTINCT custkey) FROM ko""",
    "keep_right": f"WITH {SIDES} SELECT * FROM o WHERE EXISTS (SELECT 1 FROM c WHERE o.custkey = c.custkey)",
    "two_nations": """
      SELECT b.n_name AS buyer_name, s.n_name AS seller_name, count(*) AS lines, sum(l_quantity) AS quantity
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
      LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2""",
    "exists_flag": f"WITH {SIDES} SELECT custkey, EXISTS (SELECT 1 FROM o WHERE o.custkey = c.custkey) AS has_order FROM c",
    "star_model": """
      SELECT r_name AS reg_name, p_type AS part_type, o_orderpriority AS ord_orderpriority, 'lab' AS left_out,
             count(*) AS line_count, sum(l_quantity) AS quantity, count(DISTINCT o_custkey) AS customers
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
           LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
      GROUP BY ALL""",
    "star_model_checked": """
      SELECT c_mktsegment AS cust_mktsegment, n_name AS nat_name, (SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT 'line' AS a FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) HAVING max(n) > 1
        UNION ALL SELECT 'supp' FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey) HAVING max(n) > 1)) AS left_out, count(*) AS orders, round(sum(o_totalprice), 2) AS total_price
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "enrich_projection": """
      SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS acctbal, c_name AS cust_name, c_nationkey AS cust_nationkey, c_mktsegment AS cust_mktsegment
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "project_aliases": """
      SELECT c_custkey AS "Key", c_name AS "Customer", CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS "Balance Class" FROM customer""",
    "bridge_join": """
      SELECT n_name AS nation, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "composite_grain_join": """
      WITH o AS (SELECT o_orderkey AS orderkey, strftime(o_orderdate, '%Y%m') AS yyyymm, o_orderstatus AS account, o_totalprice FROM orders),
           p AS (SELECT yyyymm, account, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS plan_price FROM o WHERE account <> 'F' GROUP BY ALL)
      SELECT yyyymm, account, orderkey, plan_price FROM o LEFT JOIN p USING (yyyymm, account)""",
    "aggregate_before_join": f"""
      WITH {SIDES}, a AS (SELECT custkey, count(*) AS order_count, round(sum(totalprice), 2) AS order_total FROM o GROUP BY 1)
      SELECT custkey, order_count, order_total FROM c LEFT JOIN a USING (custkey)""",
    "pivot_before_join": """
      WITH p AS (SELECT o_custkey AS custkey, CAST(sum(1) FILTER (o_orderstatus = 'F') AS BIGINT) AS "n_F",
                 CAST(sum(1) FILTER (o_orderstatus = 'O') AS BIGINT) AS "n_O", CAST(sum(1) FILTER (o_orderstatus = 'P') AS BIGINT) AS "n_P"
                 FROM orders GROUP BY 1)
      SELECT c_custkey AS custkey, "n_F", "n_O", "n_P" FROM customer LEFT JOIN p ON c_custkey = custkey""",
    "totals_side_by_side": """
      SELECT l.n AS lines_rows, l.v AS lines_total, o.n AS orders_rows, o.v AS orders_total
      FROM (SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem) l,
           (SELECT count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders) o""",
    "full_outer_on_grain": """
      WITH c AS (SELECT nullif(c_nationkey, 3) AS k, count(*) AS customers FROM customer GROUP BY 1),
           s AS (SELECT CASE WHEN s_nationkey = 7 THEN 107 WHEN s_nationkey <> 3 THEN s_nationkey END AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
      SELECT coalesce(c.k, s.k) AS nationkey, customers, suppliers FROM c FULL JOIN s ON c.k IS NOT DISTINCT FROM s.k""",
    "orphans": """
      SELECT s_suppkey, s_nationkey FROM supplier
      WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey <> 2 AND n_nationkey = s_nationkey)""",
    "join_match_ratio": f"""
      WITH {SIDES} SELECT 'custkey' AS join_key, count(*) AS "rows", count(c.custkey) AS matched_rows,
             round(count(c.custkey) / count(*), 4) AS match_ratio FROM o LEFT JOIN c USING (custkey)""",
    "set_analysis_sum": """
      SELECT l_linenumber, round(sum(l_extendedprice) FILTER (l_returnflag IN ('A', 'R') AND l_linestatus = 'F'), 2) AS selected_sum,
             count(*) FILTER (l_returnflag IN ('A', 'R') AND l_linestatus = 'F') AS selected_count, round(sum(l_extendedprice), 2) AS full_sum
      FROM lineitem GROUP BY 1""",
    "conditional_sum": """
      SELECT l_returnflag, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0.0 END) AS discounted_quantity FROM lineitem GROUP BY 1""",
    "only_value": """
      SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS only_flag,
             CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS only_status FROM lineitem GROUP BY 1""",
    "stats_aggs": """
      SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS stdev, round(var_samp(l_quantity), 4) AS variance,
             round(corr(l_quantity, l_extendedprice), 4) AS correl, round(covar_samp(l_quantity, l_extendedprice), 4) AS covar,
             round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 4) AS skew,
             round(kurtosis_pop(l_extendedprice), 4) AS kurtosis, round(avg(l_extendedprice), 4) AS avg,
             round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max
      FROM lineitem GROUP BY 1""",
    "median_per_group": "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price FROM lineitem GROUP BY ALL",
    "mode_per_group": """
      SELECT l_suppkey, l_quantity AS mode_quantity FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1""",
    "concat_repeats": "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey, o_orderstatus) AS statuses FROM orders GROUP BY 1",
    "concat_values": """
      SELECT o_orderstatus, string_agg(o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities
      FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) GROUP BY 1""",
    "first_last_sorted_value": """
      SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS cheapest_order,
             last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS dearest_order FROM orders GROUP BY 1""",
    "nested_aggr": """
      WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y%m') AS yyyymm, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS monthly FROM orders GROUP BY ALL)
      SELECT o_orderpriority, CAST(max(monthly) AS DOUBLE) AS best_month, CAST(sum(monthly) AS DOUBLE) / count(*) AS mean_month, count(*) AS months FROM m GROUP BY 1""",
    "distinct_count": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    "guarded_ratio": """
      SELECT o_custkey, round(u / nullif(f, 0), 6) AS urgent_to_closed FROM (
        SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS u,
               sum(CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN o_totalprice ELSE 0 END) AS f FROM orders GROUP BY 1)""",
}
