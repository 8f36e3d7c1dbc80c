"""A training corpus from `documents`: toxic texts, exact and near copies go, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferryload.llm import exactdup, mixing, neardup, packing, toxicity
from ferryload.llm.common import Workspace


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdup.drop_exact_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words to a shingle, similarity 0.8."""
    return neardup.drop_near_copies(docs, size=5, percent=80)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", _toxicity), ("exact copies", _exact), ("near copies", _near), ("source mix", _mix), ("packing", _pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            work.drop(f"stage{number - 1}")
    return docs


# A learned classifier and greedy packing are no SQL; the stages are tested against plain versions.
ORACLE_SQL = None
