"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word pairs, and pairs with one word between, each hashed to one of
2^20 coordinates. FTRL keeps per coordinate a sum of adjusted gradients z and of squared gradients n: the rate of
a coordinate falls with its own gradients, and a coordinate with |z| <= L1 has weight 0, so the model is a short
list of weights.

The model is fitted on at most `most_rows` labelled rows, those with the smallest hashes of their doc_id. So the
list of ids that picks their texts is small enough to be broadcast (1 MB), and no text is moved to find its label.
Texts become coordinates where they lie, and only these are moved. The rows are dealt by hashes of id and text to shards
of about `shard_rows` rows and `shard_bytes` of text; a shard is learned in one task, in an order that depends on the
rows alone, and the shards' weights are averaged. A model has at most 2^20 weights, which bounds what is
collected and broadcast (12 MB) whatever the corpus. Every document is scored on its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ferryload.llm.common import Workspace, WordHashes, arrow_rows, mix, whole

DIMENSIONS = 1 << 20
_WEIGHTS = StructType([StructField("at", IntegerType()), StructField("weight", DoubleType())])
# Every byte that is no ASCII letter, digit or part of a longer character parts words; A-Z become a-z.
_TABLE = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_KNOWN_WORDS = 100_000
#: Whole texts that Python gets at once.
_ARROW_ROWS = 1000
_BIAS, _FIRST = np.zeros(1, np.uint64), np.ones(1, bool)


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: rate of a coordinate is alpha / (beta + sqrt(its squared gradients)). l1: penalty per square root of
    the rows of a shard, as chance gradients grow with that; l2: penalty. most_rows: bound of the labelled rows that are
    learned from; shard_rows, shard_bytes: rows, and bytes of their texts, learned in one task, in this many passes."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.08
    l2: float = 1.0
    passes: int = 3
    most_rows: int = 40_000
    shard_rows: int = 20_000
    shard_bytes: int = 48 << 20
    threshold: float = 0.3


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct coordinates of a text; coordinate 0 is the bias, which every text has."""
    h = hashes.array((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())
    grams = [h]
    if len(h) > 1:
        grams.append(mix(h[:-1] * np.uint64(3) + h[1:]))
    if len(h) > 2:
        grams.append(mix(h[:-2] * np.uint64(5) + h[2:] + np.uint64(1)))
    at = (np.concatenate([*grams, _BIAS]) >> np.uint64(44)).astype(np.int32)
    at.sort()
    return at[np.concatenate([_FIRST, at[1:] != at[:-1]])]


def learn(rows: list[tuple[np.ndarray, int]], how: Ftrl) -> np.ndarray:
    """Weights after `passes` passes over the rows in their order."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    how = replace(how, l1=how.l1 * len(rows) ** 0.5)
    for _ in range(how.passes):
        for at, label in rows:
            w = _weights(z[at], n[at], how)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            squares = n[at]
            grown = squares + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(squares)) / how.alpha * w
            n[at] = grown
    return _weights(z, n, how)


def _weights(z: np.ndarray, n: np.ndarray, how: Ftrl) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - how.l1, 0.0)
    return -shrunk / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)


def fit(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> np.ndarray:
    """Weights from the labelled rows of ``docs`` that are not held out. Without any, all weights are 0."""
    chosen = labels_of(labels).where(~held_out("doc_id")).withColumn("order", F.xxhash64("doc_id", F.lit(7)))
    chosen = chosen.orderBy("order", "doc_id").limit(how.most_rows)  # documented bound of the fit
    labelled = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most most_rows ids
    size = labelled.select(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-size["rows"] // how.shard_rows), -(-(size["bytes"] or 0) // how.shard_bytes))

    @F.pandas_udf(BinaryType())
    def coordinates(texts: pd.Series) -> pd.Series:
        hashes = WordHashes(_KNOWN_WORDS)
        return pd.Series([features(t, hashes).tobytes() for t in texts], dtype=object)

    def shard(table: pa.Table) -> pa.Table:
        key = table.select(["order", "doc_id", "tie", "label"]).append_column("row", pa.array(np.arange(len(table))))
        in_order = key.sort_by([(c, "ascending") for c in ("order", "doc_id", "tie")])
        found = [np.frombuffer(v.as_buffer(), np.int32) for v in table["at"]]  # views of the table's bytes
        weights = learn([(found[i], y) for i, y in zip(in_order["row"].to_pylist(), in_order["label"].to_pylist())], how)
        at = np.flatnonzero(weights)
        return pa.table({"at": pa.array(at.astype(np.int32)), "weight": pa.array(weights[at])})

    tie = F.xxhash64("text")
    dealt = labelled.select("order", "doc_id", tie.alias("tie"), F.col("label").cast("int").alias("label"), coordinates("text").alias("at"),
                            F.pmod(F.xxhash64("order", tie), F.lit(shards)).alias("shard"))
    with arrow_rows(docs.sparkSession, _ARROW_ROWS):
        found = dealt.groupBy("shard").applyInArrow(shard, _WEIGHTS).groupBy("at").agg(F.sum("weight").alias("weight")).toPandas()
    weights = np.zeros(DIMENSIONS, np.float64)
    weights[found["at"].to_numpy(np.int64)] = found["weight"].to_numpy(np.float64) / shards
    return weights


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` (any columns, with text) and a column ``score``, 0 to 1; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        weight, hashes = shared.value, WordHashes(_KNOWN_WORDS)
        sums = np.fromiter((weight[features(t, hashes)].sum(dtype=np.float64) for t in texts), np.float64, len(texts))
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn("score", score("text"))


def labels_of(labels: DataFrame, column: str = "toxic") -> DataFrame:
    """One (doc_id, label) per doc_id; null ids and labels are left out; where labels differ, the larger counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= threshold).

    A null doc_id is not held out and has no label. Empty and null texts get the score of the bias alone. Only the
    text is a feature. Repeated rows get equal scores. An empty table gives an empty result; without labels every
    score is 0.5.
    """
    texts = docs.select("doc_id", "text")
    return scored(texts, fit(docs, labels, how)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= how.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> DataFrame:
    """``docs`` with all its columns, without the rows scored at or above the threshold. They are written to the shared
    folder here, as whoever reads the result decides how many whole texts Python gets at once."""
    work = Workspace(docs.sparkSession, "toxicity")
    columns = [F.col(c) for c in docs.columns]
    body = docs.select(F.struct(*columns).alias("_row"), F.col("text"))
    clean = scored(body, fit(docs, labels, how)).where(F.col("score") < how.threshold).select("_row.*")
    with arrow_rows(docs.sparkSession, _ARROW_ROWS):
        return work.write(clean, "clean")
