"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by their leading bytes, each group again by the bytes that follow, until a group has
one member or its texts have ended. Bytes are compared as they are; no digest decides equality. A digit is
a run of bytes whose width grows by a factor per round, so the longest text takes a logarithmic number of
rounds. Every document meets its first digit only by name and 64 bytes; only those that share it move with
their text, and a text loses the digit that has been looked at.

A split is an aggregate (combined before the shuffle, so thousands of copies become one row per task) and an
inner join back, whose hot keys adaptive execution splits. No window or list holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryload.llm.common import Workspace, whole

FIRST_DIGIT_BYTES = 64
DIGIT_GROWTH = 8


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any, and of rows with
    the same doc_id and text exactly one stays. Null texts equal empty ones. Other columns are not looked at.
    An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "exactdup")
    texts = docs.select("doc_id", whole("text").cast("binary").alias("rest")).withColumn("sha", F.sha2("rest", 256))
    heads = texts.select("doc_id", "sha", F.substring("rest", 1, FIRST_DIGIT_BYTES).alias("head"))
    shared = heads.groupBy("head").agg(F.count("*").alias("n"))
    first = work.write(heads.join(shared, "head"), "first")
    done = [first.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))]

    wanted = first.where("n > 1").select(F.col("doc_id").alias("id"), "head")
    same = F.expr("doc_id <=> id") & (F.substring("rest", 1, FIRST_DIGIT_BYTES) == F.col("head"))
    active = texts.join(wanted, same, "left_semi").withColumn("row", F.monotonically_increasing_id())
    active = work.write(active.withColumn("grp", F.lit(0).cast("long")), "active")

    width, step = FIRST_DIGIT_BYTES * DIGIT_GROWTH, 0
    while not active.isEmpty():
        digits = active.select("doc_id", "row", "sha", "grp", F.substring("rest", 1, width).alias("digit"),
                               (F.length("rest") <= width).alias("ended"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        by = ["grp", "digit", "ended"]
        groups = digits.groupBy(by).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))
        split = digits.join(groups, by).select(
            "doc_id", "row", "sha", F.col("best.row").alias("grp"), "n", F.col("best.doc_id").alias("keep_id"),
            (F.col("ended") | (F.col("n") == 1)).alias("over"), "rest")
        split = split.withColumn("rest", F.when(~F.col("over"), F.col("rest")))
        made = work.write(split, f"step{step}")
        done.append(made.where("over").select(
            "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("grp")).alias("kept"),
            F.col("sha").alias("text_sha256")))
        active = made.where("not over").select("doc_id", "row", "sha", "grp", "rest")
        width, step = width * DIGIT_GROWTH, step + 1

    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the copies: one row of each text."""
    columns = docs.columns
    marks = exact_groups(docs).groupBy(F.struct("doc_id", "text_sha256").alias("_copy_key")).agg(F.max("kept").alias("_copy_kept"))
    marks = marks.where("_copy_kept").select("_copy_key")
    keyed = docs.withColumn("_copy_key", F.struct(F.col("doc_id"), F.sha2(whole("text").cast("binary"), 256).alias("text_sha256")))
    return keyed.join(marks, "_copy_key").dropDuplicates(["_copy_key"]).select(*columns)
