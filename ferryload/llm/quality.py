"""Quality rules: an isolation forest on rule statistics.

Every text is read once for its statistics, all of which the forest looks at, unrounded. It is grown from a bounded sample
of labelled rows: `trees` times `sample` of them (100 x 256 by default, documented bounds), the classical size at which
more rows add nothing. Trees are grown on the rows labelled good, with cuts drawn from the box of all labelled rows, so
that parts without good rows are split off early. A statistic is chosen for a cut in proportion to how far it separates
good from junk labels (the largest distance of the two distributions), none less than `least_weight`. The anomaly score
is 2^(-mean path length / expected path length). The threshold is calibrated on all labelled rows, from histograms of
scores that Spark counts: of those that reject at most `clean_loss` of the good rows, the one with the most junk share less
good share rejected, and the lowest of equal ones. Without junk labels it is the lowest within `clean_loss`.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ferryload.llm.common import Workspace, WordHashes, window_hashes

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits"]
SHARES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "log_words"]
_COUNTS = StructType([StructField("doc_id", StringType())] + [StructField(c, LongType()) for c in COUNTS])


@dataclass(frozen=True)
class Forest:
    """trees, sample: bounds of the rows that the forest is grown from; clean_loss: share of good rows that may be rejected;
    least_weight: of a statistic in the choice of cuts, where 1 is one that separates the labels fully."""

    trees: int = 100
    sample: int = 256
    clean_loss: float = 0.003
    least_weight: float = 0.1
    bins: int = 10_000
    seed: int = 11


def statistics(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """COUNTS of one text. A word is a run without ASCII blanks; a line counts if it has a word."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen, copies, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            copies += line in seen
            seen.add(line)
    repeated = 0
    if n >= 4:
        _, which, times = np.unique(window_hashes(hashes.array(words), 3), return_inverse=True, return_counts=True)
        twice = times[which] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : n - 2 + i] |= twice
        repeated = int(inside.sum())
    letters = Counter(text)
    blanks, symbols = sum(letters[c] for c in BLANKS), sum(letters[c] for c in SYMBOLS)
    upper = sum(k for c, k in letters.items() if c.isupper())
    digits = sum(letters[c] for c in "0123456789")
    return n, len(text) - blanks, symbols, copies, repeated, lines, upper, digits


def counted(docs: DataFrame) -> DataFrame:
    def run(frames):
        hashes = WordHashes()
        for frame in frames:
            out = pd.DataFrame([statistics(t, hashes) for t in frame["text"]], columns=COUNTS)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy(object))
            yield out

    # ids pass through pandas as text: a null among them would turn the others into floating point
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, _COUNTS)
    return counts.withColumn("doc_id", F.col("doc_id").cast("long"))


def shares(counts: DataFrame) -> DataFrame:
    """Adds SHARES; all 0 for a text without words. Only log_words, in powers of two, grows with a text's length."""
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return counts.withColumns({
        "word_length": part("word_chars", "n_words"), "symbol_share": part("n_symbols", "word_chars"),
        "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words"),
        "upper_share": part("n_upper", "word_chars"), "digit_share": part("n_digits", "word_chars"),
        "log_words": F.log2(F.greatest("n_words", F.lit(1)))})


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2.0 * (sum(1.0 / i for i in range(1, n)) - (n - 1) / n)


def separation(good: np.ndarray, junk: np.ndarray) -> np.ndarray:
    """Largest distance of the two distributions of each statistic, 0 to 1; all 1 if there is nothing to compare."""
    if not len(good) or not len(junk):
        return np.ones(good.shape[1])
    out = []
    for a, b in zip(np.sort(good, axis=0).T, np.sort(junk, axis=0).T):
        at = np.concatenate([a, b])
        out.append(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())
    return np.array(out)


def grow(rows: np.ndarray, how: Forest, others: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature or -1, cut, left child, path length at a leaf); right child is left + 1. ``others``, the junk,
    widens the box that cuts are drawn from and weighs the statistics."""
    chance, forest = np.random.default_rng(how.seed), []
    if not len(rows):
        return forest
    everything = rows if others is None else np.concatenate([rows, others])
    weights = np.maximum(separation(rows, everything[len(rows):]), how.least_weight)
    depth_limit = math.ceil(math.log2(max(2, min(how.sample, len(rows)))))
    for _ in range(how.trees):
        feature, cut, left, length = [-1], [0.0], [0], [0.0]
        box = np.array([everything.min(axis=0), everything.max(axis=0)])
        todo = [(0, rows[chance.choice(len(rows), min(how.sample, len(rows)), replace=False)], 0, box)]
        while todo:
            node, part, depth, (low, high) = todo.pop()
            varied = np.flatnonzero(high > low)
            if depth >= depth_limit or len(part) <= 1 or not len(varied):
                length[node] = depth + expected_path(len(part))
                continue
            f = int(chance.choice(varied, p=weights[varied] / weights[varied].sum()))
            c = chance.uniform(low[f], high[f])
            below = part[:, f] <= c
            feature[node], cut[node], left[node] = f, c, len(feature)
            under, over = np.array([low, high]), np.array([low, high])
            under[1, f] = over[0, f] = c
            for side, inside in ((below, under), (~below, over)):
                todo.append((len(feature), part[side], depth + 1, inside))
                feature.append(-1), cut.append(0.0), left.append(0), length.append(0.0)
        forest.append((np.array(feature), np.array(cut), np.array(left), np.array(length)))
    return forest


def anomaly(forest: list, rows: np.ndarray, sample: int) -> np.ndarray:
    """Score 0 to 1 of each row; high where rows are isolated early. Without a forest 0."""
    if not forest or not len(rows):
        return np.zeros(len(rows))
    total = np.zeros(len(rows))
    for feature, cut, left, length in forest:
        at = np.zeros(len(rows), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = left[node] + (rows[inner, feature[node]] > cut[node])
            inner = inner[feature[at[inner]] >= 0]
        total += length[at]
    return 2.0 ** (-total / len(forest) / max(expected_path(sample), 1e-9))


def calibrated(good: dict[int, int], junk: dict[int, int], how: Forest) -> float:
    """Threshold from the number of good and junk rows per bin of scores; it lies above the highest bin that stays."""
    n_good, n_junk = sum(good.values()), sum(junk.values())
    bins = sorted({*good, *junk}, reverse=True)
    threshold, best, lost, caught = (bins[0] + 1) / how.bins if bins else 0.0, 0.0, 0, 0
    for at, below in zip(bins, [*bins[1:], -1]):
        lost, caught = lost + good.get(at, 0), caught + junk.get(at, 0)
        if lost > how.clean_loss * n_good:
            break
        value = caught / n_junk - lost / max(n_good, 1) if n_junk else lost
        if value >= best:
            threshold, best = (below + 1) / how.bins, value
    return threshold


def quality(docs: DataFrame, labels: DataFrame, how: Forest = Forest()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: not base_failed, and
    no more anomalous than the threshold. Labels (doc_id, quality 0/1) are reduced to one per doc_id, the smaller if they
    differ; null ids and labels are left out. Without rows labelled good only the base rules judge. Null texts count as
    empty; repeated rows are judged alike; other columns are not looked at.
    """
    spark = docs.sparkSession
    table = Workspace(spark, "quality").write(shares(counted(docs)), "statistics")
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = table.where(~failed).join(good, "doc_id")

    rows = judged.orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id", *SHARES).limit(how.trees * how.sample).select("good", *SHARES).toPandas()
    sides = [rows.loc[side, SHARES].to_numpy(np.float64) for side in (rows["good"] == 1, rows["good"] != 1)]
    forest, sample = grow(sides[0], how, sides[1]), min(how.sample, max(2, len(sides[0])))

    @F.pandas_udf(DoubleType())
    def scored(parts: pd.DataFrame) -> pd.Series:
        return pd.Series(anomaly(forest, parts[SHARES].to_numpy(np.float64), sample))

    table = table.withColumn("anomaly", scored(F.struct(*SHARES)))
    binned = judged.select((F.col("good") == 1).alias("is_good"), F.floor(scored(F.struct(*SHARES)) * how.bins).cast("int").alias("bin"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in binned.groupBy("is_good", "bin").count().collect():
        counts[r["is_good"]][r["bin"]] = r["count"]
    threshold = calibrated(counts[True], counts[False], how)
    kept = ~failed & (F.col("anomaly") < threshold if counts[True] else F.lit(True))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), "anomaly", kept.alias("kept"))
