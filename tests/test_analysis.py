"""Reconciliation, KPIs, catalogue, cycles, logs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferryload.functions.classes import date_storage, field_category, kpi_theme
from ferryload.operators import catalog, metrics, reconcile, usage
from ferryload.session import ensure_checkpoint_dir

ENTITY_SCHEMA = "table_name string, position int, field_name string, tags array<string>, detected_runtime_type string, target_type string"
SALES = [("Customer", "$text"), ("ActualSales", "$numeric"), ("BudgetSales", "$numeric"), ("GrossMarginRate", "$numeric"), ("Units", "$numeric"), ("Calendar.Date", "$date"),
         ("ActualFlag", "$numeric"), ("ProductCode", "$text"), ("Region", "$text"), ("Country", "$text"), ("State", "$text")]
CLAIMS = [("ClaimID", "$text"), ("ClaimAmount", "$numeric"), ("AllowedAmount", "$numeric"), ("ServiceDate", "$date"), ("ProviderState", "$text")]
OPERATIONS = [("Region", "$text"), ("Status", "$text"), ("OpenCount", "$numeric")]


def entities(spark, **tables):
    rows = [(name, i, f, [tag], None, "BOOLEAN" if f.endswith("Flag") else "") for name, fields in tables.items() for i, (f, tag) in enumerate(fields)]
    frame = spark.createDataFrame(rows, ENTITY_SCHEMA).withColumn("target_column", F.lit("")).withColumn("distinct_count", F.lit(3))
    return metrics.entities(frame.withColumn("inferred_category", field_category(F.col("field_name"), F.col("tags"), F.lit(""))))


def test_roles_kpis_and_hierarchies(spark):
    found = entities(spark, sales=SALES, claims=CLAIMS, operations=OPERATIONS).cache()
    roles = {(r["table_name"], r["source_column"]): r["entity_type"] for r in found.collect()}
    assert roles["sales", "Calendar.Date"] == "DATE" and roles["sales", "ActualFlag"] == "FLAG" and roles["sales", "ProductCode"] == "IDENTIFIER"
    assert roles["sales", "ActualSales"] == "MEASURE" and roles["sales", "Region"] == "DIMENSION" and roles["claims", "ClaimID"] == "IDENTIFIER"
    kpis = {(r["table_name"], r["kpi_name"]): r for r in metrics.kpi_catalog(found).collect()}
    assert kpis["sales", "Actual Sales"]["recommended_formula"] == "SUM(actual_sales)"
    assert kpis["sales", "Gross Margin Rate"]["aggregation_type"] == "AVG" and kpis["sales", "Actual Flag"]["aggregation_type"] == "COUNT"
    assert kpis["sales", "Actual Sales"]["date_column"] == "calendar_date"
    assert kpis["sales", "Actual Sales"]["grain"] == "By Customer, Region, Country, State, Calendar Date"
    assert kpis["sales", "Actual Sales"]["dimensions"] == ["customer", "region", "country", "state"]
    assert not [name for table, name in kpis if table == "claims" and "Sales" in name] and len([1 for t, _ in kpis if t == "claims"]) == 2
    trees = {r["table_name"]: r for r in metrics.hierarchies(found).collect()}
    assert set(trees) == {"sales"} and trees["sales"]["business_name"] == "Region > Country > State"
    rules = reconcile.reconciliation_rules(metrics.kpi_catalog(found), found.where("entity_type = 'DIMENSION'").select("table_name", F.col("source_column").alias("dimension"), "position"))
    groups = {(r["table_name"], r["metric_name"]): r for r in reconcile.rules_by_metric(rules).collect()}
    sales = groups["sales", "Actual Sales"]
    assert (sales["total_checks"], sales["date_check_count"], sales["dimension_check_count"], sales["has_total_check"]) == (4, 1, 2, True)
    assert groups["operations", "Open Count"]["date_check_count"] == 0
    edges = {(r["from_node"], r["to_node"], r["label"]) for r in metrics.layered_lineage(found, metrics.kpi_catalog(found), metrics.hierarchies(found)).where("table_name = 'sales'").collect()}
    assert ("source", "bronze_table", "ingested as") in edges and ("measure_actual_sales", "kpi_actual_sales", "feeds KPI") in edges
    assert ("dimension_region", "kpi_actual_sales", "slices KPI") in edges and ("dimension_region", "hierarchy_region_country_state", "hierarchy level") in edges
    score = {r["table_name"]: r["readiness_score"] for r in metrics.readiness(found, metrics.kpi_catalog(found), metrics.hierarchies(found), rules, found.limit(0)).collect()}
    assert score == {"sales": 90, "claims": 70, "operations": 80}  # "id" in ProviderState makes it an identifier


def test_kpis_run_and_themes(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", None, None), ("b", 4.0, False)], "g string, v double, f boolean")
    kpis = [("s", "SUM", "v"), ("m", "AVG", "v"), ("c", "COUNT", "f")]
    assert {r["kpi_name"]: r["kpi_value"] for r in metrics.run_kpis(df, kpis).collect()} == {"s": 5.0, "m": 2.5, "c": 2.0}
    assert {(r["g"], r["kpi_name"]): r["kpi_value"] for r in metrics.run_kpis(df, kpis, {"g": F.col("g")}).collect()}["b", "s"] == 4.0
    themes = spark.createDataFrame([("Budget Units",), ("Active Flag",), ("Latest Forecast",), ("Xyz",)], "t string").select("t", kpi_theme(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in themes.collect()} == {
        "Budget Units": "Budget / planning metrics", "Active Flag": "Flag / indicator metrics", "Latest Forecast": "Forecast metrics", "Xyz": "Other metrics"}


def test_reconciliation(spark):
    source = spark.createDataFrame([("e", 10.0), ("w", 0.0), (None, 5.0), ("gone", 1.0)], "g string, v double")
    target = spark.createDataFrame([("e", 10.0005), ("w", 1.0), (None, 5.0), ("new", 2.0)], "g string, v double")
    got = {r["g"]: r for r in reconcile.compare_by_dimension(source, target, {"v": F.sum("v")}, "g").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"e": "passed", "w": "failed", None: "passed", "gone": "failed", "new": "failed"}
    assert got["w"]["percentage_variance"] is None and got["w"]["absolute_variance"] == 1.0
    total = reconcile.compare(source, target, {"v": F.sum("v"), "n": F.count("*")}).collect()
    assert {r["metric_name"]: r["status"] for r in total} == {"v": "failed", "n": "passed"}
    totals = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric_name string, metric_total double")
    checked = reconcile.expected_totals(totals, spark.createDataFrame([("a", 1.0)], "metric_name string, expected_total double"))
    assert {r["metric_name"]: r["status"] for r in checked.collect()} == {"a": "passed", "b": "pending"}


def brute_circular(edges):
    following = defaultdict(set)
    for a, b in edges:
        following[a].add(b)

    def reaches(start, end):
        seen, todo = set(), [start]
        while todo:
            node = todo.pop()
            for after in following[node]:
                if after == end and node != end:
                    return True
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return False

    return {(a, b): reaches(b, a) for a, b in edges}


@pytest.mark.parametrize("seed,nodes,links", [(1, 12, 14), (2, 15, 30), (3, 30, 32)])
def test_cycles_against_search(spark, seed, nodes, links):
    pick = random.Random(seed)
    edges = [(f"n{pick.randrange(nodes)}", f"n{pick.randrange(nodes)}") for _ in range(links)] + [("hub", f"n{i}") for i in range(nodes)]
    got = catalog.circular_relationships(spark.createDataFrame(edges, "src string, dst string"))
    assert got.count() == len(edges)
    assert {(r["src"], r["dst"]): r["is_circular"] for r in got.collect()} == brute_circular(edges)


@pytest.mark.parametrize("seed", [5])
def test_chains_rings_and_loops_against_search(spark, seed):
    pick = random.Random(seed)
    chain = lambda name, n, start=None, end=None: list(zip([start or f"{name}0", *(f"{name}{i}" for i in range(1, n))], [*(f"{name}{i}" for i in range(1, n)), end or f"{name}{n}"]))
    edges = [*chain("tail", 9), *chain("ring", 7, "ring0", "ring0"), *chain("loop", 5, "hub", "hub"), *chain("out", 6, "hub", "far"), *chain("back", 4, "far", "hub"),
             *chain("leave", 3, "ring3", "tail4"), *chain("two", 4, "p", "q"), *chain("three", 3, "q", "p")]
    edges += [(pick.choice(edges)[0], pick.choice(edges)[1]) for _ in range(seed - 3)]
    got = catalog.circular_relationships(spark.createDataFrame(edges, "src string, dst string"))
    assert {(r["src"], r["dst"]): r["is_circular"] for r in got.collect()} == brute_circular(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = catalog.cut_lineage
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: rounds.append(1) or keep(df))
    edges = [(f"c{i}", f"c{i + 1}") for i in range(500)] + [(f"r{i}", f"r{(i + 1) % 60}") for i in range(60)]
    got = catalog.circular_relationships(spark.createDataFrame(edges, "src string, dst string"))
    assert got.groupBy(F.substring("src", 1, 1).alias("s"), "is_circular").count().collect().__len__() == 2
    assert got.where("is_circular").count() == 60 and len(rounds) < 30


def test_self_links_need_a_larger_cycle(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "m"), ("m", "x"), ("x", "y"), ("y", "x"), ("y", "y")]
    got = catalog.circular_relationships(spark.createDataFrame(edges, "src string, dst string"))
    assert {(r["src"], r["dst"]): r["is_circular"] for r in got.collect()} == brute_circular(edges)
    assert brute_circular(edges)["m", "m"] is False and brute_circular(edges)["y", "y"] is True


def test_cycles_without_any(spark):
    got = catalog.circular_relationships(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), (None, "a")], "src string, dst string"))
    assert [r["is_circular"] for r in got.collect()] == [False] * 4


def test_expression_names_of_many_words(spark):
    fields = spark.createDataFrame([("a", n) for n in ("Sales", "Sales Amount", "Sales Amount Net", "%Key", "Größe m", "a.b", "x ")] + [("b", "Net")], "app_id string, field_name string")
    texts = ["Sum(Sales Amount Net)", "Sales_Amount + SalesX", "[%Key] & [Sales]", "Größe m/Größe", "a.bc + xa.b", "[nope] + Net", "[x ] + [a.b]", "", None]
    expressions = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "app_id string, expression_id int, expression string")
    found = sorted((r["expression_id"], r["field_name"], r["is_known"]) for r in catalog.expression_fields(expressions, fields).collect())
    assert found == [(0, "Sales", True), (0, "Sales Amount", True), (0, "Sales Amount Net", True), (2, "%Key", True), (2, "Sales", True), (3, "Größe m", True),
                     (5, "nope", False), (6, "a.b", True), (6, "x ", True)]


def test_broken_references_within_an_app(spark):
    edges = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y"), ("a", "x", None)], "app_id string, source string, target string")
    nodes = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("a", "x")], "app_id string, node_id string")
    assert sorted((r["app_id"], r["target"]) for r in catalog.broken_references(edges, nodes).collect() if r["target"]) == [("b", "y")]
    assert catalog.broken_references(edges, nodes).count() == 2 and catalog.broken_references(edges.drop("app_id"), nodes.drop("app_id")).count() == 1


def test_measured_levels_keep_every_candidate(spark):
    rows = spark.createDataFrame([("E", "de", "x"), ("E", "fr", "x"), ("A", "us", "x"), ("A", "de", None)], "region string, country string, state string")
    listed = metrics.measured_levels(rows, [(0, 0, "region"), (0, 1, "country"), (0, 1, "state")]).collect()
    assert {(r["lower_level"], r["upper_level"], r["lower_values"], r["ambiguous_values"], r["is_dependent"]) for r in listed} == {
        ("region", None, None, None, None), ("country", "region", 3, 1, False), ("state", "region", 2, 1, False)}


FIELDS = "app_id string, table_name string, position int, field_name string"


@pytest.mark.parametrize("tables", [6, 20, 21, 200])
def test_associations_say_the_same_at_every_size(spark, tables):
    rows = [("a", f"t{i:03d}", p, n) for i in range(tables) for p, n in enumerate(["OrderID" if i % 2 else "orderid", "Name", "x"])] + [("b", "t00", 0, "OrderID"), ("a", "t000", 7, "ORDERID")]
    fields = catalog.with_key_flag(spark.createDataFrame(rows, FIELDS)).where("field_name <> 'x'")
    links = catalog.associations(fields).collect()
    assert len(links) == tables and {(r["app_id"], r["field"], r["table_count"], r["hub_table"]) for r in links} == {("a", "orderid", tables, "t000")}
    assert {r["table_name"]: r["side"] for r in links if r["side"] == "many"} == {"t000": "many"}
    marked = fields.withColumn("field_name", F.concat(F.lit("%"), "field_name"))
    keys = catalog.synthetic_keys(marked).collect()
    assert len(keys) == tables and {(r["shared_fields"], r["field_count"], r["table_count"]) for r in keys} == {("%name, %orderid", 2, tables)}


def test_table_roles_and_composite_keys(spark):
    rows = [("a", "Bridge", 0, "XID"), ("a", "Bridge", 1, "YID"), ("a", "Sales", 0, "Amount"), ("a", "MasterCalendar", 0, "Year"), ("a", "Big", 0, "Text"), ("a", "Plain", 0, "Text")]
    fields = catalog.with_key_flag(spark.createDataFrame(rows, FIELDS))
    sizes = spark.createDataFrame([("a", "Big", 10001), ("a", "Plain", 10000)], "app_id string, table_name string, row_count bigint")
    assert {r["table_name"]: r["table_role"] for r in catalog.table_roles(fields, sizes).collect()} == {
        "Bridge": "bridge", "Sales": "fact", "MasterCalendar": "canonical_calendar", "Big": "dimension", "Plain": "dimension"}
    assert [r["key_fields"] for r in catalog.composite_keys(fields).collect()] == ["XID, YID"]


def test_expression_fields(spark):
    expressions = spark.createDataFrame([(1, "Sum(Sales Amount) / Count([Cust Key])"), (2, "SalesAmount + Größe"), (3, ""), (4, None), (5, "Amount[Sales]")], "expression_id int, expression string")
    fields = spark.createDataFrame([("Sales Amount",), ("Cust Key",), ("Sales",), ("Amount",), ("Größe",)], "field_name string")
    got = {(r["expression_id"], r["field_name"]) for r in catalog.expression_fields(expressions, fields).collect()}
    assert got == {(1, "Sales Amount"), (1, "Cust Key"), (1, "Sales"), (1, "Amount"), (2, "Größe"), (5, "Amount"), (5, "Sales")}


def test_date_storage(spark):
    rows = spark.createDataFrame([("YYYYMM", True), ("OrderDate", False), ("OrderDate", True), ("Region", False), ("last_at", False)], "n string, s boolean")
    assert [r[0] for r in rows.select(date_storage(F.col("n"), F.col("s"))).collect()] == ["integer_yyyymm", "date", "unknown", "unknown", "date"]


def test_usage_logs(spark):
    calls = spark.createDataFrame([("s", "openai/gpt-4o", "migration", "x" * 10, "", None), ("s", "other", "repair", "", "y" * 9, 100), ("t", "other", "repair", "", "", None)],
                                  "session_id string, model string, purpose string, prompt_text string, completion_text string, reported_prompt_tokens int")
    log = usage.with_cost(calls)
    assert [(r["prompt_tokens"], r["completion_tokens"], float(r["cost"])) for r in log.orderBy("session_id", "purpose").collect()] == [(2, 1, 2.5e-05), (100, 2, 0.000212), (1, 1, 8e-06)]
    assert usage.usage_summary(log).first()["unique_sessions"] == 2
    jobs = spark.createDataFrame([("j1", 8, 2, 0, 0.9, 3), ("j2", 7, 2, 1, 0.5, 4), ("j3", 0, 0, 0, 0.0, 0)], "job_id string, rule_based int, llm_fallback int, failed int, confidence double, repair_iterations int")
    phases = spark.createDataFrame([("j1", "parse", 30000.0), ("j3", "plan", 30001.0)], "job_id string, phase string, duration_ms double")
    assert sorted((r["job_id"], r["alert"]) for r in usage.job_alerts(jobs, phases).collect()) == [
        ("j2", "failed_translations"), ("j2", "low_confidence"), ("j2", "many_repairs"), ("j3", "slow_phase")]
    assert {r["job_id"]: r["fallback_rate"] for r in usage.job_rates(jobs).collect()} == {"j1": 0.2, "j2": 0.2, "j3": 0.0}
    empty = spark.createDataFrame([], "rating int")
    assert usage.feedback_summary(empty).first()["positive_rate"] == 0.0


def test_checkpoint_folder_is_set_once(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == first


def test_no_dimension_is_cut_off(spark):
    rows = [("t", i, f"col_{i}", f"col_{i}", "STRING", "DIMENSION", f"Col {i}") for i in range(12)] + [("t", 12, "amount", "amount", "DOUBLE", "MEASURE", "Amount")]
    found = spark.createDataFrame(rows, "table_name string, position int, source_column string, target_column string, target_type string, entity_type string, business_name string")
    (kpi,) = metrics.kpi_catalog(found).collect()
    assert len(kpi["dimensions"]) == 12 and kpi["grain"].count(",") == 11
    assert len(metrics.kpi_catalog(found, limit=3).first()["dimensions"]) == 3
    regions = spark.createDataFrame([("t", f"region_{i}", i) for i in range(7)], "table_name string, dimension string, position int")
    assert reconcile.major_dimensions(regions).count() == 7


def test_apps_share_nothing(spark):
    edges = spark.createDataFrame([("a", "x", "y"), ("b", "y", "x"), ("c", "x", "y"), ("c", "y", "x")], "app_id string, src string, dst string")
    assert {(r["app_id"], r["is_circular"]) for r in catalog.circular_relationships(edges).collect()} == {("a", False), ("b", False), ("c", True)}
    expressions = spark.createDataFrame([("a", 1, "Sum([Sales]) + [Gone]"), ("b", 2, "Sum(Sales)")], "app_id string, expression_id int, expression string")
    fields = spark.createDataFrame([("a", "t", "Sales"), ("b", "t", "Other")], "app_id string, table_name string, field_name string")
    found = catalog.expression_fields(expressions, fields).collect()
    assert {(r["app_id"], r["field_name"], r["is_known"]) for r in found} == {("a", "Sales", True), ("a", "Gone", False)}
    objects = expressions.withColumnRenamed("expression_id", "object_id").withColumn("object_type", F.lit("meas"))
    targets = {(r["app_id"], r["target"]) for r in catalog.lineage_edges(objects, fields).where("edge_type = 'uses_field'").collect()}
    assert targets == {("a", "fld_t.Sales"), ("a", "fld_Gone")}


def test_names_and_nodes_do_not_pass_through_the_driver(spark):
    """Few expressions by size, so that Spark alone would send all their words to the driver."""
    rows = lambda values, columns: spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
    fields = rows("('t', 'Sales Amount'), ('t', 'size'), ('u', 'size')", "table_name, field_name")
    objects = rows("('1', 'm', 'Sum(Sales Amount) + size + [gone]')", "object_id, object_type, expression")
    edges = catalog.lineage_edges(objects, fields)
    nodes = rows("('m_1'), ('fld_t.size'), ('tbl_t'), ('fld_t.Sales Amount')", "node_id")
    broken = catalog.broken_references(edges, nodes)
    assert "Broadcast" not in broken._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["source"], r["target"]) for r in broken.collect()) == [("fld_u.size", "tbl_u"), ("m_1", "fld_gone"), ("m_1", "fld_u.size")]
