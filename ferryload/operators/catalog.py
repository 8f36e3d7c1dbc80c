"""Catalogue, association and lineage tables.

Catalogue rows are ``(app_id, table_name, position, field_name, is_key)``. One job covers
many apps; associations and cycles never leave an app.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    ASSOCIATION_STOP_FIELDS,
    CHECKLIST,
    FACT_NAME_TOKENS,
)
from ferryload.functions.classes import expression_class
from ferryload.functions.text import contains_any, is_key_name
from ferryload.operators.ordering import keep_first
from ferryload.session import cut_lineage


def with_key_flag(fields: DataFrame) -> DataFrame:
    """Adds ``is_key`` by name."""
    return fields.withColumn("is_key", is_key_name(F.col("field_name")))


def field_registry(fields: DataFrame) -> DataFrame:
    """Field → tables, one row per pair, with the number of tables of the field.

    A list per field would put a common name's tables into one cell; rows do not.
    """
    uses = fields.select("app_id", F.lower("field_name").alias("field"), "table_name").distinct()
    counts = uses.groupBy("app_id", "field").agg(F.count("*").alias("table_count"))
    return uses.join(counts, ["app_id", "field"])


def associations(fields: DataFrame) -> DataFrame:
    """G1: tables of an app that share a field, one row per (field, table).

    All tables with the same ``(app_id, field)`` are associated with each other; ``hub_table`` is the first by name. This
    form says the same at every size and grows with the catalogue, where a list of table pairs grows with its square.
    ``side`` is measured per (field, table): ``one`` where the field occurs once in the table, else ``many``.
    """
    linked = fields.where((F.lower("field_name") != "") & (F.col("is_key") | ~F.lower("field_name").isin(ASSOCIATION_STOP_FIELDS)))
    uses = linked.groupBy("app_id", F.lower("field_name").alias("field"), "table_name").agg(
        F.min("field_name").alias("field_name"), F.count("*").alias("occurrences")
    )
    sizes = uses.groupBy("app_id", "field").agg(F.count("*").alias("table_count"), F.min("table_name").alias("hub_table"))
    return uses.join(sizes.where("table_count > 1"), ["app_id", "field"]).withColumn(
        "side", F.when(F.col("occurrences") == 1, "one").otherwise("many")
    )


def synthetic_keys(fields: DataFrame) -> DataFrame:
    """Tables of an app that share ``%`` fields, one row per (combination of shared fields, table).

    A table's combination holds its ``%`` fields that another table has, too; it is as long as the table has such fields.
    """
    marked = fields.where(F.col("field_name").startswith("%")).withColumn("is_key", F.lit(True))
    combined = associations(marked).groupBy("app_id", "table_name").agg(
        F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("shared_fields"), F.count("*").alias("field_count")
    )
    sizes = combined.groupBy("app_id", "shared_fields").agg(F.count("*").alias("table_count"))
    return combined.join(sizes, ["app_id", "shared_fields"]).withColumn("relationship", F.lit("synthetic_key"))


def composite_keys(fields: DataFrame) -> DataFrame:
    """Tables with more than one key field; the list is as long as a table has keys."""
    keys = fields.where("is_key").groupBy("app_id", "table_name").agg(
        F.count("*").alias("key_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "field_name"))), lambda s: s["field_name"]), ", ").alias("key_fields"),
    )
    return keys.where("key_count > 1").withColumn("relationship", F.lit("composite_key"))


def table_roles(fields: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Bridge, fact, calendar or dimension, from key counts and name; the row count is reported, a role does not
    change with a table's size."""
    counts = fields.groupBy("app_id", "table_name").agg(
        F.count_if("is_key").alias("key_count"), F.count_if(~F.col("is_key")).alias("other_count")
    ).join(row_counts.select("app_id", "table_name", "row_count"), ["app_id", "table_name"], "left")
    name = F.lower("table_name")
    fact = contains_any(name, FACT_NAME_TOKENS) | (F.col("key_count") >= 3)
    role = (
        F.when((F.col("key_count") >= 2) & (F.col("other_count") <= 1), "bridge").when(fact, "fact")
        .when(name.contains("calendar") | name.endswith("date"), "canonical_calendar").otherwise("dimension")
    )
    return counts.withColumn("table_role", role)


def field_statistics(fields: DataFrame) -> DataFrame:
    """Fields and keys per table."""
    return fields.groupBy("app_id", "table_name").agg(
        F.count("*").alias("field_count"), F.count_if("is_key").alias("key_count"),
        F.when(F.count_if("is_key") > 1, "fact").otherwise("dimension").alias("node_type"),
    )


def fields_by_class(fields: DataFrame) -> DataFrame:
    """Field names of a table per class, in field order."""
    listed = F.array_sort(F.collect_list(F.struct("position", "field_name")))
    return fields.where(F.col("inferred_category") != "UNKNOWN").groupBy("table_name", "inferred_category").agg(
        F.count("*").alias("field_count"),
        F.array_join(F.transform(listed, lambda s: s["field_name"]), "|").alias("field_names"),
    )


# --- cycles --------------------------------------------------------------------

STEPS_PER_ROUND = 3


def circular_relationships(edges: DataFrame) -> DataFrame:
    """Every edge ``(src, dst)`` with ``is_circular``: the end can reach the start again. With an ``app_id``, nodes of
    different apps are different nodes, and the result has it, too.

    An edge lies on a cycle when both ends are in the same strongly connected part of the graph. Nodes with one link in
    and one link out are first taken out of their chains by pointer jumping, whose rounds grow with the logarithm of a
    chain, and nodes that nothing leads to or leaves are dropped. Parts of what remains are found with a label per node, so
    the work per round is a few passes over the links; reachable pairs are never listed. Each round is checkpointed.
    """
    if "app_id" in edges.columns:
        inside = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct("app_id", F.col(c).cast("string").alias("node"))))
        marked = circular_relationships(edges.select(inside("src").alias("src"), inside("dst").alias("dst")))
        part = lambda c, name: F.get_json_object(c, f"$.{name}")
        return marked.select(F.coalesce(part("src", "app_id"), part("dst", "app_id")).alias("app_id"), part("src", "node").alias("src"),
                             part("dst", "node").alias("dst"), "is_circular")
    # The ends are compared within this job only, so text is a common type for all of them.
    all_edges = cut_lineage(
        edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    )
    links = cut_lineage(all_edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    parts, levels = links.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0), []
    while True:
        links, shrunk = _shrink(links)
        levels += shrunk
        if links.isEmpty():
            break
        found = _parts(links)
        parts = parts.unionByName(found)
        done = found.select(F.col("node").alias("__n"))
        links = links.join(done, F.col("src") == F.col("__n"), "left_anti")
        links = cut_lineage(links.join(done, F.col("dst") == F.col("__n"), "left_anti").select("src", "dst"))
    for level in reversed(levels):
        parts = _unfold(parts, *level)
    # A part of one node is no cycle; an edge from a node to itself needs a larger one, too.
    larger = parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
    parts = cut_lineage(parts.join(larger.select("part"), "part", "left_semi"))
    source = parts.select(F.col("node").alias("src"), F.col("part").alias("__src_part"))
    target = parts.select(F.col("node").alias("dst"), F.col("part").alias("__dst_part"))
    marked = all_edges.join(source, "src", "left").join(target, "dst", "left")
    same = F.coalesce(F.col("__src_part") == F.col("__dst_part"), F.lit(False))
    return marked.select("src", "dst", same.alias("is_circular"))


def _shrink(links: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, DataFrame]]]:
    """Links without dead ends and without chain nodes, and what was taken out of chains, level by level.

    Dead ends go a layer at a time; what a layer leaves behind as a chain goes at once.
    """
    levels, size = [], links.count()
    while size:
        inner = _inner_nodes(links)
        if not inner.isEmpty():
            links, level = _contract(links, inner)
            levels.append(level)
        starts = links.select(F.col("src").alias("__n")).distinct()
        ends = links.select(F.col("dst").alias("__n")).distinct()
        kept = links.join(ends, F.col("src") == F.col("__n"), "left_semi").join(starts, F.col("dst") == F.col("__n"), "left_semi")
        links = cut_lineage(kept.select("src", "dst"))
        before, size = size, links.count()
        if size == before:
            break
    return links, levels


def _inner_nodes(links: DataFrame) -> DataFrame:
    """Nodes with one link in and one link out, with their neighbours."""
    out = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.max("dst").alias("ahead")).where("n_out = 1")
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.max("src").alias("back")).where("n_in = 1")
    return cut_lineage(out.join(into, "node").select("node", "back", "ahead"))


def _contract(links: DataFrame, inner: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Links from the start of each chain to its end, and (chain nodes with start and end, nodes of rings that are nothing but
    chain, nodes that a chain leads back to).

    A pointer jumps as far as the node it points to has jumped, so its reach doubles with each step. It ends outside the
    chain; in a ring it never ends, and the least name that it has passed becomes the ring's.
    """
    chain, before = inner.select("node", "back", "ahead", F.col("node").alias("least")), None
    while True:
        following = chain.select(F.col("node").alias("ahead"), F.col("ahead").alias("__ahead"), F.col("least").alias("__least"))
        leading = chain.select(F.col("node").alias("back"), F.col("back").alias("__back"))
        jumped = chain.join(following, "ahead", "left").join(leading, "back", "left")
        least = F.least("least", "__least")
        chain = cut_lineage(jumped.select(  # each step reads the last one three times
            "node", F.coalesce("__back", "back").alias("back"), F.coalesce("__ahead", "ahead").alias("ahead"), least.alias("least"),
            F.col("__ahead").isNotNull().alias("open"), (least < F.col("least")).alias("fell")))
        left = chain.agg(F.count_if("open").alias("open"), F.count_if("fell").alias("fell")).first()
        # Of a chain of n nodes, n - 2^step pointers ahead are open, and as many back: fewer in each step until none is. In a
        # ring all stay open, and names fall until all are the least.
        if not left["open"] or (left["open"] == before and not left["fell"]):
            break
        before = left["open"]
    in_ring = chain.join(inner.select(F.col("node").alias("ahead")), "ahead", "left_semi")
    rings = cut_lineage(in_ring.select("node", F.col("least").alias("part")))
    ended = chain.join(rings.select("node"), "node", "left_anti")
    within = inner.select(F.col("node").alias("__n"))
    outer = links.join(within, F.col("src") == F.col("__n"), "left_anti").join(within, F.col("dst") == F.col("__n"), "left_anti")
    spans = cut_lineage(ended.select("node", F.col("back").alias("src"), F.col("ahead").alias("dst")))
    joined = outer.select("src", "dst").unionByName(spans.select("src", "dst").where("src <> dst")).distinct()
    loops = spans.where("src = dst").select(F.col("src").alias("node")).distinct()
    return cut_lineage(joined), (spans, rings, loops)


def _unfold(parts: DataFrame, spans: DataFrame, rings: DataFrame, loops: DataFrame) -> DataFrame:
    """Parts of the nodes before a contraction: a chain belongs to the part that both its ends are in."""
    alone = loops.join(parts, "node", "left_anti").select("node", F.col("node").alias("part"))
    known = cut_lineage(parts.unionByName(alone))
    start = known.select(F.col("node").alias("src"), F.col("part").alias("__a"))
    end = known.select(F.col("node").alias("dst"), F.col("part").alias("__b"))
    between = spans.join(start, "src").join(end, "dst").where("__a = __b").select("node", F.col("__a").alias("part"))
    return known.unionByName(between).unionByName(rings)


def _parts(links: DataFrame) -> DataFrame:
    """Strongly connected parts around the largest nodes, as ``(node, part)``.

    A node's label is the largest node that reaches it. Within the nodes of one label,
    those that also reach that node form its part.
    """
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    labels = _spread_largest(links, nodes.select("node", F.col("node").alias("label")))
    source = labels.select(F.col("node").alias("src"), F.col("label").alias("__a"))
    target = labels.select(F.col("node").alias("dst"), F.col("label").alias("__b"))
    inside = links.join(source, "src").join(target, "dst").where("__a = __b")
    backwards = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    is_root = labels.select("node", (F.col("node") == F.col("label")).cast("int").alias("label"))
    reaches_root = _spread_largest(backwards, is_root).where("label = 1").select("node")
    return cut_lineage(labels.withColumnRenamed("label", "part").join(reaches_root, "node", "left_semi"))


def _spread_largest(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Pass labels along the links, keeping the largest at each node, until nothing changes."""
    # Each node is linked to itself, so that one join brings its own label, too.
    loops = labels.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    links = cut_lineage(links.unionByName(loops))
    labels = labels.select("node", "label")
    while True:
        for _ in range(STEPS_PER_ROUND):
            own = F.max(F.when(F.col("src") == F.col("dst"), F.col("label")))
            labels = links.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy(
                F.col("dst").alias("node")
            ).agg(F.max("label").alias("label"), own.alias("own"))
        labels = cut_lineage(labels)
        if labels.where("label <> own").isEmpty():
            return labels.select("node", "label")


# --- expressions and lineage ------------------------------------------------------

def expression_fields(expressions: DataFrame, fields: DataFrame, key: str = "expression_id") -> DataFrame:
    """Fields an expression names in brackets or as whole words; ``is_known`` is false for a name in brackets that is no
    field, so that broken references can be found. With an ``app_id`` on both sides, names are looked up within the app.

    Names are indexed by their first word: an expression meets the names that begin with one of its words, and whether the
    rest of the name follows is looked up inside the row. So the cost depends neither on expressions × fields nor on the longest name.
    Joins hash a part of the names per task; the words of the expressions, of which there are many more, pass by unsorted.
    """
    app = ["app_id"] if "app_id" in expressions.columns and "app_id" in fields.columns else []
    pieces_of = lambda c: F.regexp_extract_all(c, F.lit(r"((?U)\w+|(?U)\W+)"), F.lit(1))
    is_word = lambda piece: piece.rlike(r"(?U)^\w")
    mark = chr(1)  # between pieces, so that a name is found at their borders only
    marked = lambda p: F.concat(F.lit(mark), F.array_join(p, mark), F.lit(mark))
    names = fields.select(*app, "field_name").where("field_name <> ''").distinct().withColumn("__p", pieces_of(F.col("field_name")))
    by_words = is_word(F.element_at("__p", 1)) & is_word(F.element_at("__p", -1))
    names = names.select(*app, "field_name", F.when(by_words, F.element_at("__p", 1)).alias("__first"), F.when(by_words, marked(F.col("__p"))).alias("__name"))

    rows = expressions.select(*app, key, "expression").withColumn("__p", pieces_of(F.col("expression"))).select(
        *app, key, marked(F.col("__p")).alias("__text"), F.array_distinct(F.filter("__p", is_word)).alias("__words"),
        F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\[(.*?)\]"), F.lit(1))).alias("__brackets"))
    follows = F.coalesce(F.contains("__text", "__name"), F.lit(False))
    words = rows.select(*app, key, "__text", F.explode("__words").alias("__first"))
    named = words.join(names.where("__first IS NOT NULL").hint("shuffle_hash"), [*app, "__first"]).where(follows)
    brackets = rows.select(*app, key, "__text", F.explode("__brackets").alias("field_name"))
    looked_up = brackets.join(names.withColumn("is_known", F.lit(True)).hint("shuffle_hash"), [*app, "field_name"], "left").where(~follows)
    return named.select(*app, key, "field_name", F.lit(True).alias("is_known")).unionByName(
        looked_up.select(*app, key, "field_name", F.coalesce("is_known", F.lit(False)).alias("is_known")))


def lineage_edges(expressions: DataFrame, fields: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Object → field → table edges.

    ``expressions`` has ``object_id, object_type, expression``; ``fields`` has ``table_name,
    field_name``, both with an ``app_id`` where several apps are read; ``uses`` are known ``source, target, edge_type`` links such as a visual
    and its library measures.
    """
    objects = expressions.withColumn("expression_id", F.concat_ws("_", "object_type", "object_id"))
    named = expression_fields(objects, fields)
    node = F.concat(F.lit("fld_"), F.col("table_name"), F.lit("."), F.col("field_name"))
    app = ["app_id"] if "app_id" in named.columns else []
    located = fields.select(*app, "field_name", "table_name").distinct()
    edge = lambda df, s, t, kind: df.select(*app, s.alias("source"), t.alias("target"), F.lit(kind).alias("edge_type"))
    unknown = F.concat(F.lit("fld_"), "field_name")
    parts = [
        edge(named.where("is_known").join(located.hint("shuffle_hash"), [*app, "field_name"]), F.col("expression_id"), node, "uses_field"),
        edge(named.where("NOT is_known"), F.col("expression_id"), unknown, "uses_field"),
        edge(located, node, F.concat(F.lit("tbl_"), F.col("table_name")), "belongs_to_table"),
    ]
    if uses is not None:
        parts.append(uses.select(*app, "source", "target", "edge_type"))
    return reduce(DataFrame.unionByName, parts)


def broken_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is not a node; with an ``app_id`` on both sides, not a node of the edge's app. Joins hash
    a part of the nodes per task; the edges pass by unsorted, and a node that many of them name is one row."""
    app = ["app_id"] if "app_id" in edges.columns and "app_id" in nodes.columns else []
    known = nodes.select(*app, "node_id").distinct()
    end = lambda name: known.select(*app, F.col("node_id").alias(name), F.lit(True).alias(f"__{name}")).hint("shuffle_hash")
    ends = edges.join(end("source"), [*app, "source"], "left").join(end("target"), [*app, "target"], "left")
    return ends.where("__source IS NULL OR __target IS NULL").select(*edges.columns)


def distinct_expressions(expressions: DataFrame) -> DataFrame:
    """Each expression once per context and type, ignoring case; the first one is kept."""
    trimmed = expressions.withColumn("__k", F.lower(F.trim("expression"))).where("__k <> ''")
    first = keep_first(trimmed, ["__k", "context_id", "expression_type"], ["position"])
    return first.drop("__k").withColumn("classification", expression_class(F.col("expression")))


def expression_class_counts(expressions: DataFrame, *keys: str) -> DataFrame:
    """Expressions per class."""
    return expressions.groupBy(*keys, expression_class(F.col("expression")).alias("classification")).agg(
        F.count("*").alias("expressions")
    )


def duplicate_ids(objects: DataFrame, keys: Sequence[str] = ("app_id", "object_id")) -> DataFrame:
    """Ids used by more than one object."""
    return objects.groupBy(*keys).agg(F.count("*").alias("uses")).where("uses > 1")


def completeness(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Score per app: 10 per kind of object that exists, bonus points, at most 100.

    ``objects`` has ``app_id, object_type, object_id``; ``edges`` has ``app_id, source, target`` between object ids.
    """
    present = objects.groupBy("app_id").agg(
        sum((F.max(F.when(F.col("object_type") == kind, 1).otherwise(0)) for kind in CHECKLIST), F.lit(0)).alias("kinds"),
        F.max(F.when(F.col("object_type") == "loadScript", 1).otherwise(0)).alias("script"),
        F.max(F.when(F.col("object_type") == "rawObjects", 1).otherwise(0)).alias("raw"),
    )
    repeated = duplicate_ids(objects).groupBy("app_id").agg(F.count("*").alias("duplicate_ids"))
    known = objects.select("app_id", F.col("object_id").alias("node")).distinct()
    ends = edges.select("app_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    broken = ends.join(known, ["app_id", "node"], "left_anti").groupBy("app_id").agg(F.count("*").alias("broken_ends"))
    bonus = lambda condition: F.when(condition, 5).otherwise(0)
    duplicates, open_ends = F.coalesce("duplicate_ids", F.lit(0)), F.coalesce("broken_ends", F.lit(0))
    score = (
        F.col("kinds") * 10 + bonus(duplicates == 0) + bonus(open_ends == 0)
        + bonus(F.col("raw") == 1) + bonus(F.col("script") == 1)
    )
    return present.join(repeated, "app_id", "left").join(broken, "app_id", "left").select(
        "app_id", F.col("kinds").alias("kinds_present"), duplicates.alias("duplicate_ids"),
        open_ends.alias("broken_ends"), F.least(score, F.lit(100)).alias("completeness_score"),
    )


def table_sizes(**tables: DataFrame) -> DataFrame:
    """Row count per table as catalogue rows."""
    tagged = [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("table_name").agg(F.count("*").alias("row_count"))
