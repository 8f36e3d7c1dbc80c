"""Phrase collocations by dynamic itemset counting.

The corpus is written once as chunks of word numbers, dealt to `shards`. Steps scan the shards in a cycle, one a step.
Words are counted from the first step on. A longer phrase is active from the step after both its subphrases (without
its last and without its first word) have reached the threshold, whatever lengths are being counted meanwhile, and is
counted for one full cycle, so every shard counts for it once. The steps end when no phrase has become active during a
full cycle.

The scans count 64-bit hashes. Which phrases have reached the threshold, and in which step, is told by an array of
SLOTS step numbers (8 MB, whatever the corpus) that is broadcast. It is a Bloom filter with steps for bits: two phrases
in one slot make one of them active early, never late, and an early phrase still has one full cycle, which begins when
all its subphrases are active. Sums of phrases
that share a hash are too large, never too small. So no frequent phrase is lost, and an exact count, by texts, of those
that remain follows; a filter that is fuller than planned costs time, not results. Phrases that are complete below the
threshold are dropped after their last step.

A step's counts go through the shared folder, so a lost executor repeats a step at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryload.llm.common import Workspace, mix, whole

SLOTS = 1 << 23
NEVER = 255
_CHUNK_WORDS, _SLICE_BYTES = 1 << 20, 1 << 21
# Marks of a piece's end become byte 255, which UTF-8 does not have; A-Z become a-z. Blank and tab part words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(255 if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = "shard int, lang string, n_words long, words array<string>, ids binary"
_COUNT = "h long, k int, last int, n long"
_EXACT = "lang string, k int, phrase string, n long"


@dataclass(frozen=True)
class Phrases:
    """least: threshold of a phrase; longest: words of a phrase; part, of: a phrase goes if a longer one that holds it has
    at least part / of of its count; top: phrases a language; shards: scans of a cycle (longest * shards stays below 255)."""

    least: int = 30
    longest: int = 4
    part: int = 80
    of: int = 100
    top: int = 2000
    shards: int = 3


class Numbers(dict):
    """Words in the order in which they occur first; number 0 ends a piece."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Numbers of the words of ``text``, which may hold byte 255; each distinct word is looked up once."""
        one = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text)])
        words = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
        known = np.fromiter((self[w] if w else -1 for w in words.dictionary.cast(pa.binary()).to_pylist()), np.int32, len(words.dictionary))
        ids = known[words.indices.to_numpy()]
        return ids[ids >= 0]


def chunks(docs: DataFrame, shards: int) -> DataFrame:
    """Word numbers of ``docs`` (lang, text), one row per language and about _CHUNK_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(number % shards, lang, int(sum(np.count_nonzero(p) for p in parts)), list(words)[1:], np.concatenate(parts).tobytes())
                    for lang, (words, parts) in held.items()]
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                                               pa.array([pa.array(w, pa.binary()).cast(pa.string()) for w in columns[3]], pa.list_(pa.string())),
                                               pa.array(columns[4], pa.binary())], names=["shard", "lang", "n_words", "words", "ids"])

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())
            for lang, some in _slices(langs, texts):
                numbers, parts = held.setdefault(lang, (Numbers(), []))
                parts.append(numbers.of(b"\xff".join([*some, b""]).translate(_TABLE).replace(b"\xff", b" \xff ")))
                size += len(parts[-1])
                if size >= _CHUNK_WORDS:
                    yield flush()
                    held.clear()
                    size, number = 0, number + 1
        if held:
            yield flush()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole("text").alias("text"))
    return rows.mapInArrow(run, _CHUNK)


def _slices(langs: list[str], texts: pa.Array) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about _SLICE_BYTES at once."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(langs, texts):
        some, size = held.get(lang, ([], 0))
        some.append(text.as_py())
        size += len(some[-1])
        if size >= _SLICE_BYTES:
            yield lang, some
            some, size = [], 0
        held[lang] = some, size
    for lang, (some, _) in held.items():
        if some:
            yield lang, some


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """Hashes by word number; number 0 has none."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((0, *(xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist())), np.uint64, len(words) + 1)


def longer(h: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Hash of a phrase with one more word, of then ``k`` words."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k))


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(SLOTS - 1), (h >> np.uint64(24)) & np.uint64(SLOTS - 1)


def since(steps: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step from which a phrase counts as frequent, or NEVER."""
    one, two = slots(h)
    return np.maximum(steps[one], steps[two])


def active(steps: np.ndarray, ids: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length from 2 on: (length, where phrases with frequent subphrases start, their hashes, the step since when they are active)."""
    reached = since(steps, hashes)
    reached[0] = NEVER
    at = np.flatnonzero(reached[ids] != NEVER)
    h, step = hashes[ids[at]], reached[ids[at]]
    for k in range(2, longest + 1):
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)  # both subphrases stand here
        at, start = at[follows], np.maximum(step[follows], step[follows + 1])
        h = longer(h[follows], hashes[ids[at + k - 1]], k)
        yield k, at, h, start
        step = np.maximum(since(steps, h), start)  # a shared slot may be early: the phrase is not met before its subphrases
        keep = step != NEVER
        at, h, step = at[keep], h[keep], step[keep]


def scan(ids: np.ndarray, hashes: np.ndarray, steps: np.ndarray, step: int, how: Phrases) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of one chunk in one step: (length, hashes, last step in which they are counted, occurrences)."""
    found = []
    if step < how.shards:
        n = np.bincount(ids, minlength=len(hashes))[1:]
        found.append((1, hashes[1:], np.full(len(n), how.shards - 1), n))
    for k, _, h, start in active(steps, ids, hashes, how.longest):
        now = (start <= step) & (step < start.astype(np.int64) + how.shards)
        some, first, n = np.unique(h[now], return_index=True, return_counts=True)
        found.append((k, some, start[now][first].astype(np.int64) + how.shards - 1, n))
    return found


def exact(lang: str, words: pa.Array, ids: np.ndarray, keep: np.ndarray, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Exact counts by text of the phrases of one chunk whose hashes are kept, per length."""
    hashes = word_hashes(lang, words)
    n = np.bincount(ids, minlength=len(hashes))
    some = np.flatnonzero((since(keep, hashes) != NEVER) & (n > 0) & (np.arange(len(n)) > 0))
    yield 1, words.take(pa.array(some - 1)), n[some]
    for k, at, h, _ in active(keep, ids, hashes, longest):
        at = at[since(keep, h) != NEVER]
        code = ids[at].astype(np.int64)
        for i in range(1, k):  # numbers of distinct prefixes, then one word more: no hashes
            code = np.unique(code, return_inverse=True)[1] * np.int64(len(hashes)) + ids[at + i]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        parts = [words.take(pa.array(ids[at[first] + i].astype(np.int64) - 1)) for i in range(k)]
        yield k, pc.binary_join_element_wise(*parts, " "), n


def _chunk_of(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for lang, words, ids in zip(batch.column("lang"), batch.column("words"), batch.column("ids")):
        yield lang.as_py(), words.values, np.frombuffer(ids.as_buffer(), np.int32)


def frequent(docs: DataFrame, how: Phrases = Phrases()) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases with n >= how.least, words included, and (lang, n) of all words."""
    spark = docs.sparkSession
    if not 0 < how.longest * how.shards < NEVER:
        raise ValueError("longest * shards must lie between 1 and 254")
    work = Workspace(spark, "phrases")
    work.write_parts(chunks(docs, how.shards), "chunks", "shard")
    table = spark.read.schema(_CHUNK).parquet(f"{work.path}/chunks")
    steps = np.full(SLOTS, NEVER, np.uint8)
    counted, quiet, step = None, 0, 0
    while step < how.shards or quiet < how.shards:
        shared = spark.sparkContext.broadcast(steps)  # SLOTS bytes
        now = table.where(F.col("shard") == step % how.shards).select("lang", "words", "ids")
        counted = _merged(counted, now.mapInArrow(_scanner(shared, step, how), _COUNT))
        counted = work.write(counted.where((F.col("n") >= how.least) | (F.col("last") > step)), f"step{step}")
        if step:
            work.drop(f"step{step - 1}")
        shared.destroy()  # the step is written
        fresh = _slots_of(counted.where((F.col("n") >= how.least) & (F.col("k") < how.longest)))
        fresh = fresh[steps[fresh] == NEVER]
        steps[fresh] = step + 1
        quiet = 0 if len(fresh) else quiet + 1
        step += 1

    keep = np.full(SLOTS, NEVER, np.uint8)
    keep[_slots_of(counted)] = 0
    shared = spark.sparkContext.broadcast(keep)

    def count(batches):
        for batch in batches:
            for lang, words, ids in _chunk_of(batch):
                for k, phrases, n in exact(lang, words, ids, shared.value, how.longest):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), k, np.int32)),
                                                      phrases, pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"])

    sums = table.select("lang", "words", "ids").mapInArrow(count, _EXACT).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    found = work.write(sums.where(F.col("n") >= how.least), "frequent")
    shared.destroy()
    return found, table.groupBy("lang").agg(F.sum("n_words").alias("n"))


def _scanner(shared, step: int, how: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, ids in _chunk_of(batch):
                for k, h, last, n in scan(ids, word_hashes(lang, words), shared.value, step, how):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k, np.int32)), pa.array(last.astype(np.int32)),
                                                      pa.array(n.astype(np.int64))], names=["h", "k", "last", "n"])

    return run


def _merged(before: DataFrame | None, fresh: DataFrame) -> DataFrame:
    rows = fresh if before is None else before.unionByName(fresh)
    return rows.groupBy("h").agg(F.max("k").alias("k"), F.max("last").alias("last"), F.sum("n").alias("n"))


def _slots_of(counted: DataFrame) -> np.ndarray:
    """Slots of the hashes: at most SLOTS / 64 rows reach the driver."""
    h = F.col("h")
    at = counted.select(F.explode(F.array(h.bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(SLOTS - 1)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toPandas()
    bits = np.unpackbits(words["set"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words["word"].to_numpy(np.int64)[row] * 64 + bit


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """Collocations per language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), pieces end at any of . , ; : ! ? and line ends, words are parted by blanks and tabs. A
    phrase of 2 to `longest` words with a >= `least` occurrences is a candidate; its score is the least floor(2000000 * a /
    (l + r)) of its cuts, the first of equal ones, with l and r the occurrences of the two parts. It goes if a longer
    candidate holds it and has part / of of its occurrences. The first `top` of a language by score, a, phrase stay.

    Null texts count as empty, a null lang as `und`; repeated rows count as often as they occur; other columns are not
    looked at; an empty table gives an empty result.
    """
    counted, words = frequent(docs, how)
    long = counted.where("k > 1")
    pieces = F.split("phrase", " ")
    cuts = long.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k", pieces.alias("w"))
    sides = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
                        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    first = part.withColumnsRenamed({"part": "left", "f": "l"})
    rest = part.withColumnsRenamed({"part": "right", "f": "r"})
    scored = sides.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).withColumn(
        "score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")

    inner = long.where("k > 2").select("lang", "n", "k", pieces.alias("w"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    held = inner.groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase")).agg(F.max("n").alias("longer"))
    alone = best.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact(F.col("longer")) * how.of < _exact(F.col("a")) * how.part))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= how.top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
