"""Bloom filters whose bits Spark sets; a filter's size is fixed beforehand, so it can be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 6


def positions(key: Column, level: int, bits: int) -> list[Column]:
    """The bits of a key; levels hash differently."""
    first = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits - 1)) + 1
    return [F.pmod(first + F.lit(i) * step, F.lit(bits)) for i in range(HASHES)]


def set_words(keys: DataFrame, level: int, bits: int) -> dict[int, int]:
    """64-bit words of the filter of ``keys`` (key) that are not 0; at most bits / 64 rows reach the driver."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
    return {r["word"]: r["set"] for r in words.collect()}
