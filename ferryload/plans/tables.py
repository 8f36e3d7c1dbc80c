"""Access to the given tables for the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of one data folder, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def plain(self, name: str) -> DataFrame:
        """The table with its one- or two-letter column prefix removed, so shared fields share a name."""
        df = getattr(self, name)
        return df.toDF(*[plain_name(c) for c in df.columns])


def plain_name(column: str) -> str:
    return re.sub(r"^[a-z]{1,2}_", "", column)


def day(column: str):
    """Timestamp column as a date."""
    return F.col(column).cast("date")


def exact_mean(column: str):
    """Mean of an amount with two decimals: exact sum, one division, so it does not depend on row order."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)
