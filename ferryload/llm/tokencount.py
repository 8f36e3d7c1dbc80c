"""Token counts through a digest cache.

The cache is a table (content, tokenizer, n_tokens): the SHA-256 of a normalised text, the SHA-256 of the tokenizer's
file with the settings that change counts, and the count. A call looks up the digests of its texts, encodes each
missing text once however often it occurs, appends what it has counted, and reads every count from the cache.

Digests are counted first. A Bloom filter holds those that occur more than once and those that are cached; it has at
most MAX_FILTER_BITS, whatever the corpus. A text that it does not hold is surely new and the only one of its kind, so
it is encoded where it lies. Only the others are shuffled, combined by digest beforehand, and encoded once each if they
are missing; a fuller filter sends more of them that way and changes no count. Cached rows may repeat (two jobs at
once, or a lost job that is run again): they agree, and one of them is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ferryload.llm.bloom import HASHES, positions, set_words
from ferryload.llm.common import Workspace, whole
from ferryload.session import folder_exists

_CACHE = "content binary, tokenizer string, n_tokens long"
_SLICE_CHARS = 400_000
BITS_PER_KEY = 12
MAX_FILTER_BITS = 1 << 26


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def count_tokens(tokenizer, texts: list[str]) -> list[int]:
    """Tokens of whole texts, without added ones, encoded in slices of bounded size."""
    counts, start = [], 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= _SLICE_CHARS):
            chars, end = chars + len(texts[end]), end + 1
        counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False)]
        start = end
    return counts


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"|no added tokens, no truncation, no padding").hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 512,
                 normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8, of the text as given), n_tokens, over_limit (n_tokens > limit).

    cache: folder of the cache table, made if missing; without it the job has a cache of its own. The tokenizer's file
    lies at tokenizer_path on every machine. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows, null ids and
    other columns are carried or ignored as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache = cache or Workspace(spark, "tokencount").path + "/cache"
    version = tokenizer_digest(tokenizer_path)

    def known() -> DataFrame:
        table = spark.read.schema(_CACHE).parquet(cache) if folder_exists(spark, cache) else spark.createDataFrame([], _CACHE)
        return table.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    body = normalise(whole("text"))
    content = F.unhex(F.sha2(body.cast("binary"), 256))
    work = Workspace(spark, "tokencount")
    often = docs.select(content.alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    often = work.write(often.unionByName(known().select(F.col("content").alias("key"))), "often")
    bits = min(MAX_FILTER_BITS, max(64, -(-often.count() * BITS_PER_KEY // 64) * 64))
    words = np.zeros(bits // 64, np.int64)
    for at, value in set_words(often, 0, bits).items():
        words[at] = value
    shared = spark.sparkContext.broadcast(words.view(np.uint64))  # at most MAX_FILTER_BITS / 8 bytes

    def encode_new(frames):
        tokenizer = load_tokenizer(tokenizer_path)
        for frame in frames:
            at = np.array(frame["at"].tolist(), np.int64).reshape(len(frame), HASHES)
            held = (((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1).all(axis=1)
            counts = np.array([None] * len(frame), object)
            counts[~held] = count_tokens(tokenizer, frame["body"][~held].tolist())
            yield pd.DataFrame({"content": frame["content"], "n_tokens": pd.array(counts, "Int64"), "body": frame["body"].where(held, None)})

    @F.pandas_udf(LongType())
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer(tokenizer_path)
        for bodies in parts:
            yield pd.Series(count_tokens(tokenizer, bodies.tolist()), dtype="int64")

    def append(rows: DataFrame) -> None:
        rows.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    place = F.array(*positions(F.col("content"), 0, bits))
    texts = docs.select(content.alias("content"), body.alias("body")).select("content", "body", place.alias("at"))
    parted = work.write(texts.mapInPandas(encode_new, "content binary, n_tokens long, body string"), "parted")
    rest = parted.where("n_tokens is null")
    missing = work.write(rest.select("content").distinct().join(known(), "content", "left_anti"), "missing")
    once = rest.groupBy("content").agg(F.first("body").alias("body")).join(missing, "content", "left_semi")
    append(parted.where("n_tokens is not null"))
    append(once.select("content", counted("body").alias("n_tokens")))

    rows = docs.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), content.alias("content"))
    return rows.join(known(), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
