"""Table checks (Q5-Q19, S17). Every check returns rows of one shape:

``check_id, check_type, expected, actual, difference, status``; ``status`` is
``passed``, ``failed`` or ``pending`` (no expectation known).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryload.fixed_values import AUDIT_COLUMNS, NULL_WARNING_PERCENT, NUMERIC_TARGET_TYPES
from ferryload.functions.casting import cast_or_null
from ferryload.operators.conversion import spelled
from ferryload.operators.joins import match_ratio


def check_row(check_id: str, check_type: str, expected: Column, actual: Column) -> list[Column]:
    """The six columns of a check; equal within 1e-9 passes, an unknown expectation stays pending, and a
    value that could not be computed (NULL) against a known one is an error."""
    expected, actual = expected.cast("double"), actual.cast("double")
    difference = actual - expected
    status = (
        F.when(expected.isNull(), "pending").when(actual.isNull(), "error")
        .when(F.abs(difference) < 1e-9, "passed").otherwise("failed")
    )
    return [
        F.lit(check_id).alias("check_id"), F.lit(check_type).alias("check_type"),
        expected.alias("expected"), actual.alias("actual"), difference.alias("difference"),
        status.alias("status"),
    ]


def stack(*checks: DataFrame) -> DataFrame:
    """Q19: several checks as one report."""
    return reduce(DataFrame.unionByName, checks)


def overall_status(report: DataFrame) -> DataFrame:
    """Q19: failed if any check failed, passed if all passed, else pending."""
    failed = F.bool_or(F.col("status").isin("failed", "error"))
    passed = F.bool_and(F.col("status") == "passed")
    return report.agg(
        F.count("*").alias("total_checks"), F.count_if(F.col("status") == "passed").alias("passed_checks"),
        F.when(failed, "failed").when(passed, "passed").otherwise("pending").alias("overall_status"),
    )


def output_checks(df: DataFrame, mapping: Sequence[dict], expected_rows: int | None = None) -> DataFrame:
    """Q5-Q7: columns (found without case), audit columns, row count and value validity, in one scan of all rows.

    An unknown row expectation passes. Cells are invalid when a DATE, BOOLEAN or
    numeric target holds a value that does not read as one.
    """
    targets = [(str(m["target_column"]).strip(), str(m.get("target_type") or "").strip().upper()) for m in mapping if m.get("target_column")]
    present = {c.lower(): c for c in reversed(df.columns)}

    def bad_cells(kinds: Sequence[str], valid) -> Column:
        columns = [present[name.lower()] for name, kind in targets if kind in kinds and name.lower() in present]
        counts = [F.count_if(F.col(f"`{c}`").isNotNull() & ~F.coalesce(valid(c), F.lit(False))) for c in columns]
        return reduce(lambda a, b: a + b, counts, F.lit(0))

    def text(column: str) -> Column:
        return F.col(f"`{column}`").cast("string")

    def reads_as_date(column: str) -> Column:
        return ~text(column).rlike(r"^\d+\.?\d*$") & text(column).try_cast("timestamp").isNotNull()

    figures = df.agg(
        F.count("*").alias("row_count"),
        bad_cells(["DATE"], reads_as_date).alias("date_conversion"),
        bad_cells(["BOOLEAN"], lambda c: F.lower(text(c)).isin("true", "false")).alias("boolean_values"),
        bad_cells(NUMERIC_TARGET_TYPES, lambda c: cast_or_null(text(c), "double").isNotNull()).alias("numeric_values"),
    )
    missing = len([name for name, _ in targets if name.lower() not in present])
    missing_audit = len([c for c in AUDIT_COLUMNS if c.lower() not in present])
    expected = F.col("row_count") if expected_rows is None else F.lit(expected_rows)
    rows = [
        check_row("column_count", "schema", F.lit(len(targets) + len(AUDIT_COLUMNS)), F.lit(len(df.columns))),
        check_row("approved_target_columns_exist", "schema", F.lit(0), F.lit(missing)),
        check_row("audit_columns_exist", "schema", F.lit(0), F.lit(missing_audit)),
        check_row("row_count", "row_count", expected, F.col("row_count")),
        *[
            check_row(name, "values", F.lit(0), F.col(name))
            for name in ("date_conversion", "boolean_values", "numeric_values")
        ],
    ]
    return figures.select(F.inline(F.array(*[F.struct(*row) for row in rows])))


def null_percentages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q8: real NULLs per column, share in percent with two decimals, warning from 25 on."""
    counts = df.agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns],
    )
    long = counts.unpivot(["row_count"], list(columns), "column_name", "null_count")
    share = F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("row_count")), F.lit(0.0))
    return long.select(
        "column_name", "null_count", "row_count", F.round(share, 2).alias("null_percentage"),
        (share >= NULL_WARNING_PERCENT).alias("warning"),
    )


def not_null(df: DataFrame, column: str, check_id: str, predicate: Column | None = None) -> DataFrame:
    """Q9: rows (under ``predicate``) without a value; 0 are expected."""
    broken = F.col(f"`{column}`").isNull() if predicate is None else predicate & F.col(f"`{column}`").isNull()
    return df.agg(F.count_if(broken).alias("n")).select(*check_row(check_id, "not_null", F.lit(0), F.col("n")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q10: key combinations that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def non_empty(df: DataFrame, check_id: str) -> DataFrame:
    """Q11: the table has at least one row; reading stops at the first one found."""
    found = df.select(F.lit(1).alias("one")).limit(1).agg(F.count("*").alias("n"))
    return found.select(*check_row(check_id, "non_empty", F.lit(1), F.col("n")))


def tagged_counts(**tables: DataFrame) -> DataFrame:
    """Row counts of several tables in one row, one column per table."""
    tagged = [df.select(F.lit(name).alias("t")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged).agg(
        *[F.count_if(F.col("t") == name).alias(name) for name in tables]
    )


def union_parity(first: DataFrame, second: DataFrame, result: DataFrame, check_id: str = "union_parity") -> DataFrame:
    """Q12: rows of the result = rows of both branches."""
    counts = tagged_counts(first=first, second=second, result=result)
    return counts.select(*check_row(check_id, "row_count", F.col("first") + F.col("second"), F.col("result")))


def load_status(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded against source rows; a load that brought nothing of a source with rows has failed."""
    match = F.col("loaded_rows") == F.col("source_rows")
    return tagged_counts(source_rows=source, loaded_rows=loaded).select(
        "source_rows", "loaded_rows", match.alias("is_match"),
        F.when(match, "success").when(F.col("loaded_rows") == 0, "failed").otherwise("completed_with_warnings").alias("status"),
    )


def branch_ownership(df: DataFrame, branch: str, owned: dict[str, Sequence[str]]) -> DataFrame:
    """Q13: per branch, cells filled in columns that only another branch owns; 0 are expected."""
    columns = [(owner, c) for owner, cs in owned.items() for c in cs]
    filled = df.groupBy(branch).agg(
        *[F.count(F.col(f"`{c}`")).alias(c) for _, c in columns]
    )
    foreign = reduce(
        lambda a, b: a + b,
        [F.when(F.col(branch) != owner, F.col(f"`{c}`")).otherwise(F.lit(0)) for owner, c in columns],
    )
    return filled.select(
        F.col(branch), foreign.alias("foreign_cells"),
        F.when(foreign == 0, "passed").otherwise("failed").alias("status"),
    )


def name_row(check_id: str, names: Sequence[str]) -> list[Column]:
    """A check on column names: their number is expected to be 0, and they are listed."""
    return [*check_row(check_id, "names", F.lit(0), F.lit(len(names))), F.lit(", ".join(names)).alias("names")]


def _name_report(spark: SparkSession, checks: dict[str, Sequence[str]]) -> DataFrame:
    rows = F.array(*[F.struct(*name_row(check_id, names)) for check_id, names in checks.items()])
    return spark.range(1).select(F.inline(rows))


def field_parity(target: DataFrame, source: DataFrame, listed: Sequence[str], result: DataFrame) -> DataFrame:
    """Q14: check rows of a target-mode concatenate: fields that the target does not have, and of these, fields that only the
    source has and the load does not list. Names are compared without case; no row of a table is read."""
    known, own, asked = ({c.lower() for c in names} for names in (target.columns, source.columns, listed))
    extra = sorted(c for c in result.columns if c.lower() not in known)
    leaked = [c for c in extra if c.lower() in own - asked]
    return _name_report(result.sparkSession, {
        "CONCATENATE_FIELD_PARITY_MISMATCH": extra, "CONCATENATE_SOURCE_ONLY_FIELD_LEAK": leaked})


def join_key_issues(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Q15: check rows of a join: key columns that do not exist, a key joined to descriptive text, and, where both exist, the
    left rows whose key the right side does not have (0 are expected)."""
    here, there = spelled(left.columns).get(left_key.lower()), spelled(right.columns).get(right_key.lower())
    descriptive = ("name", "desc", "description")
    mixed = right_key.lower().endswith(descriptive) != left_key.lower().endswith(descriptive)
    names = _name_report(left.sparkSession, {
        "JOIN_KEY_MISSING_LEFT": [] if here else [left_key], "JOIN_KEY_MISSING_RIGHT": [] if there else [right_key],
        "JOIN_KEY_TO_TEXT": [f"{left_key} = {right_key}"] if mixed else []})
    if not (here and there):
        return names
    if left.schema[here].dataType != right.schema[there].dataType:  # a number and a text are compared as texts
        left, right = (df.withColumn(key, F.col(f"`{key}`").cast("string")) for df, key in ((left, here), (right, there)))
    ratio = match_ratio(left, here, right, there)
    lost = F.coalesce(F.col("rows"), F.lit(0)) - F.col("matched_rows")
    return names.unionByName(ratio.select(*check_row("JOIN_KEY_UNMATCHED", "values", F.lit(0), lost), F.lit("").alias("names")))


def cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Q16, Q18: measured cardinality of a join and the action it needs.

    Rows are counted per key on each side and only the two maxima are compared, so a hot key is one row.
    """
    def most_rows(df: DataFrame, key: str, name: str) -> DataFrame:
        counts = df.where(F.col(f"`{key}`").isNotNull()).groupBy(f"`{key}`").agg(F.count("*").alias("n"))
        return counts.agg(F.max("n").alias(name))

    both = most_rows(left, left_key, "max_left").unionByName(
        most_rows(right, right_key, "max_right"), allowMissingColumns=True
    )
    most = both.agg(F.max("max_left").alias("max_left"), F.max("max_right").alias("max_right"))
    many_left, many_right = F.col("max_left") > 1, F.col("max_right") > 1
    kind = (
        F.when(many_left & many_right, "*:*").when(many_left, "*:1").when(many_right, "1:*").otherwise("1:1")
    )
    return most.select(
        F.lit(left_key).alias("left_key"), F.lit(right_key).alias("right_key"), "max_left", "max_right",
        kind.alias("cardinality"), (~many_right).alias("is_safe"),
        F.when(many_left & many_right, "aggregate_before_join").when(many_right, "pivot_before_join")
        .alias("required_action"),
    )


def island_tables(fields: DataFrame, fact_tables: Column) -> DataFrame:
    """Q17: tables that share no field with a fact table of their app. ``fact_tables`` marks catalogue rows of facts."""
    marked = fields.select("app_id", "table_name", F.lower("field_name").alias("field"), fact_tables.alias("is_fact"))
    shared = marked.groupBy("app_id", "field").agg(F.bool_or("is_fact").alias("in_fact"))
    others = marked.where(~F.col("is_fact")).join(shared, ["app_id", "field"])
    linked = others.groupBy("app_id", "table_name").agg(F.bool_or("in_fact").alias("linked"))
    return linked.where(~F.col("linked")).select("app_id", "table_name")


def grain_keys(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """For each candidate key set, how many combinations repeat; 0 repeats is a grain."""
    rows = []
    for keys in candidates:
        counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
        rows.append(counts.agg(
            F.lit(",".join(keys)).alias("key_columns"), F.lit(len(keys)).alias("key_count"),
            F.count_if(F.col("n") > 1).alias("repeated_keys"), (F.max("n") == 1).alias("is_grain"),
        ))
    return reduce(DataFrame.unionByName, rows)


def smallest_grain(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """The candidate with the fewest columns that identifies every row (no row if none does)."""
    return grain_keys(df, candidates).where("is_grain").orderBy("key_count", "key_columns").limit(1)
