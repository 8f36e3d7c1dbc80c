"""What several operators share: job folders, words, and hashes of words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryload.session import remove_folder, shared_folder

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


class Workspace:
    """Tables of one job in the shared folder.

    A written table survives lost executors and cuts the lineage. Results read these tables lazily,
    so the folder goes when the Python process ends; `drop` removes earlier what nobody reads again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def _remove(self) -> None:
        context = self.spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            remove_folder(self.spark, self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_parts(self, df: DataFrame, name: str, column: str) -> None:
        """Written in one folder per value of ``column``."""
        df.write.mode("overwrite").partitionBy(column).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        remove_folder(self.spark, f"{self.path}/{name}")


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that are run meanwhile hand at most ``most`` rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole(text: Column | str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, as UTF-8. ``bytes`` methods know ASCII only, which is what is asked."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hash of a word, remembered while there are not too many."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out
