"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Every document gets its set of word shingles, a MinHash signature and its band keys. Documents with the same
   set form a class; one member speaks for it.
2. Classes that share a band key are candidates. Pairs within a bucket are not all emitted: in each round a row
   meets the pivots of its bucket: one in the first round, 8 in the next two, at most 256 later. A pivot that has met
   its whole bucket is done there. Rows that links have joined in the meantime need not meet any more, so a large group
   of near copies falls together in the first rounds, and later pivots are taken from outside the bucket's largest
   component. Rounds go on until no bucket holds two unjoined rows that have not met: no cap loses a link.
3. A pair's signatures are compared batch by batch. With m of n equal values and a uniform prior, the pair goes on
   only if the posterior probability of a similarity at or above the threshold is at least the chosen miss probability.
   The first batch is two bits of 192 values, which travel with the bucket's rows, so that the join itself prunes.
   So do 512 parity bits of each set: a shingle that only one of two sets has flips one bit, so unequal bits never
   outnumber the symmetric difference, and a pair with too many of them is surely below the threshold.
4. Survivors are verified on their full sets.

The chance that banding misses a pair of similarity 0.8 is (1 - 0.8^5)^40 = 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from ferryload.llm.common import Workspace, WordHashes, arrow_rows, mix, whole, window_hashes, words_of

BANDS, ROWS, BATCH = 40, 5, 40
MISS_PROBABILITY = 1e-7
PROBES = (1, 8, 8)
PIVOTS = 256
BIT_VALUES = 192
PARITIES = 512
_KNOWN_WORDS = 100_000
#: Rows that Python gets at once: whole texts, or the full sets of a pair.
_ARROW_ROWS = 1000

_SKETCH = StructType([StructField("doc_id", StringType()), StructField("n_shingles", LongType()), StructField("fp", BinaryType()),
                      StructField("bands", ArrayType(LongType())), StructField("sig", BinaryType()), StructField("bits", ArrayType(LongType()))])
_SETS = StructType([StructField("fp", BinaryType()), StructField("shingles", BinaryType())])


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle, one without words has none."""
    found = hashes.array(words_of(text))
    return np.unique(window_hashes(found, min(size, len(found)))) if len(found) else found


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minhash_seeds() -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(steps + np.uint64(0xD1B54A32D192ED03))


def signature(shingles: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[None, start : start + 1024] * factor[:, None] + offset[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return mix(least)


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values.reshape(BANDS, ROWS)[:, i])
    return keys.view(np.int64)


def low_bits(values: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """64 bits to a number: the lowest bits of the first values, their second bits, and the parity of the number of
    shingles in each of PARITIES parts."""
    planes = [(values[:BIT_VALUES] >> np.uint64(i)).astype(np.uint8) & 1 for i in (0, 1)]
    parts = np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(np.concatenate([*planes, parts])).view(np.int64)


def fewest_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches of n with which a pair goes on: with a uniform prior the posterior of the match rate is
    Beta(m + 1, n - m + 1), and its mass above the threshold is a binomial distribution function."""
    mass, m = 0.0, -1
    while mass < miss:
        m += 1
        mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches) after each batch of whole values."""
    return [(n, fewest_matches(n, threshold, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def bits_agree(percent: int, miss: float):
    """Condition on columns n, bits, pn, pbits. Two unequal values agree in two bits by chance one time in four. At the
    threshold the symmetric difference is (100 - percent) / (100 + percent) of both sizes together."""
    words, threshold = BIT_VALUES // 64, percent / 100
    unequal = " + ".join(f"bit_count((bits[{i}] ^ pbits[{i}]) | (bits[{i + words}] ^ pbits[{i + words}]))" for i in range(words))
    parity = " + ".join(f"bit_count(bits[{i}] ^ pbits[{i}])" for i in range(2 * words, 2 * words + PARITIES // 64))
    least = fewest_matches(BIT_VALUES, threshold + (1 - threshold) / 4, miss)
    return F.expr(f"({100 + percent}) * ({parity}) <= {100 - percent} * (n + pn) and {unequal} <= {BIT_VALUES - least}")


def _sketches(size: int):
    def run(frames):
        hashes, (factor, offset) = WordHashes(_KNOWN_WORDS), minhash_seeds()
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = shingle_set(text, size, hashes)
                if not len(found):
                    rows.append((0, None, None, None, None))
                    continue
                values = signature(found, factor, offset)
                rows.append((len(found), fingerprint(found), band_keys(values), values.astype(np.uint16).tobytes(), low_bits(values, found)))
            out = pd.DataFrame(rows, columns=["n_shingles", "fp", "bands", "sig", "bits"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy(object))
            yield out

    return run


def _sets(size: int):
    def run(frames):
        hashes = WordHashes(_KNOWN_WORDS)
        for frame in frames:
            rows = [(fingerprint(s), s.tobytes()) for s in (shingle_set(t, size, hashes) for t in frame["text"]) if len(s)]
            yield pd.DataFrame(rows, columns=["fp", "shingles"])

    return run


def _likely(threshold: float, miss: float):
    tests = least_matches(threshold, miss)

    @F.pandas_udf(BooleanType())
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
        right = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
        alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for n, fewest in tests:
            equal = left[alive, n - BATCH : n] == right[alive, n - BATCH : n]
            matches = matches + equal.sum(axis=1)
            goes_on = matches >= fewest
            alive, matches = alive[goes_on], matches[goes_on]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pd.Series(out)

    return likely


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int64)
    for i, (left, right) in enumerate(zip(a, b)):
        x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out[i] = np.count_nonzero(y[at] == x)
    return pd.Series(out)


def _linked(work: Workspace, pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    likely = _likely(percent / 100, MISS_PROBABILITY)
    for side in "ab":
        pairs = pairs.join(sigs.select(F.col("cls").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    left = work.write(pairs.where(likely("sig_a", "sig_b")).select("a", "b"), f"{name}-likely")
    for side in "ab":
        left = left.join(sets.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"set_{side}")), side)
    common = left.select("a", "b", "n_a", "n_b", _common("set_a", "set_b").alias("common"))
    return work.write(common.where(F.expr(f"100 * common >= {percent} * (n_a + n_b - common)")).select("a", "b"), name)


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(u, v): v is the smallest node that u reaches, for each u that is not itself the smallest of its component.

    Alternating large and small stars: neighbours move to the smallest neighbour until only stars are left.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    for step in range(100):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.write(large, f"{name}-large{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, stars = stars, work.write(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"{name}-small{step}")
        heads = stars.groupBy("u").agg(F.count("*").alias("n")).unionByName(stars.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n")).distinct())
        if heads.groupBy("u").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("k > 1 or n > 1").isEmpty():
            return stars
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII blanks, A-Z lower-cased; a set has the distinct shingles of ``size`` words. Rows link
    when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable. Texts without words
    (null, empty, blanks) have no shingles and link with nothing. A null doc_id is larger than any; of repeated rows
    with one doc_id exactly one is kept. Other columns are not looked at.
    """
    with arrow_rows(docs.sparkSession, _ARROW_ROWS):  # all that needs Python is written before this returns
        return _near_groups(docs, size, percent)


def _near_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    work = Workspace(docs.sparkSession, "neardup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ids pass through pandas as text: a null among them would turn the others into floating point
    sketches = texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_sketches(size), _SKETCH)
    sketches = sketches.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())
    all_rows = work.write(sketches, "sketches")

    classes = all_rows.where("n_shingles > 0").groupBy("fp").agg(F.min("row").alias("cls"))
    members = work.write(all_rows.select("doc_id", "row", "n_shingles", "fp").join(classes, "fp", "left")
                         .select("doc_id", "row", "n_shingles", F.coalesce("cls", "row").alias("cls")), "members")

    speakers = members.where("row = cls and n_shingles > 0").select("cls")
    speakers = all_rows.join(speakers, all_rows["row"] == speakers["cls"])
    keys = speakers.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = work.write(keys.join(shared, "key"), "keys")
    sigs = all_rows.join(buckets.select("cls").distinct(), F.col("row") == F.col("cls"))
    sigs = work.write(sigs.select("cls", F.col("n_shingles").alias("n"), "doc_id", "fp", "sig", "bits"), "sigs")
    buckets = work.write(buckets.join(sigs.select("cls", "n", "bits"), "cls"), "buckets")
    wanted = sigs.select(F.col("doc_id").alias("id"))
    sets = texts.join(wanted, F.expr("doc_id <=> id"), "left_semi").mapInPandas(_sets(size), _SETS)
    sets = work.write(sigs.select("cls", "n", "fp").join(sets, "fp").dropDuplicates(["cls"]).select("cls", "n", "shingles"), "sets")

    fits = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    pair = [F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")]
    agree = bits_agree(percent, MISS_PROBABILITY)
    stars = docs.sparkSession.createDataFrame([], "u long, v long")
    live, step = buckets, 0
    while True:
        labelled = live.join(stars.select(F.col("u").alias("cls"), "v"), "cls", "left").select("key", "cls", "n", "bits", F.coalesce("v", "cls").alias("label"))
        labels = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.count("*").alias("labels"), F.sum("c").alias("size"), F.max_by("label", "c").alias("major"), (F.sum("c") - F.max("c")).alias("minor"))
        live = work.write(labelled.join(labels.where("labels > 1").drop("labels"), "key"), f"live{step}")
        if live.isEmpty():
            break
        most = PROBES[step] if step < len(PROBES) else PIVOTS
        probing = step < len(PROBES)
        choice = live if probing else live.where("label != major")
        slot = F.when(F.col("size" if probing else "minor") <= most, F.col("cls")).otherwise(F.pmod(F.xxhash64("cls", F.lit(step)), F.lit(most)))
        pivots = choice.groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("cls", "n", "label", "bits"), "cls").alias("p"))
        pivots = pivots.select("key", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.label").alias("plabel"), F.col("p.bits").alias("pbits"))
        met = live.join(pivots, "key").where((F.col("label") != F.col("plabel")) & fits & agree)
        edges = _linked(work, met.select(*pair).distinct(), sigs, sets, percent, f"edges{step}")
        if not edges.isEmpty():
            stars = components(work, edges.unionByName(stars.toDF("a", "b")), f"stars{step}")
        live = live.join(pivots.select("key", F.col("pivot").alias("cls")), ["key", "cls"], "left_anti").select("key", "cls", "n", "bits")
        step += 1

    rooted = members.join(stars.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
    rooted = rooted.select("doc_id", "row", "n_shingles", F.coalesce("root", "cls").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    heads = rooted.groupBy("root").agg(first)
    return rooted.join(heads, "root").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"),
                                             (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, with one document of each component: the smallest doc_id's.

    Rows that share a doc_id stay together if one of them is kept (exact copies are another operator's work).
    """
    columns = docs.columns
    kept = near_groups(docs, size, percent).groupBy(F.struct("doc_id").alias("_near_key")).agg(F.max("kept").alias("_near_kept"))
    kept = kept.where("_near_kept").select("_near_key")
    return docs.withColumn("_near_key", F.struct("doc_id")).join(kept, "_near_key").select(*columns)
