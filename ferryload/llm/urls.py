"""URL filters: prefix rules by host and path, then exact block-list membership by a cascade of Bloom filters.

The cascade knows its universe, the distinct hosts of the corpus. Level 1 encodes the listed hosts; level 2 the hosts of
the universe that pass level 1 without being listed; level 3 the listed hosts that pass level 2, and so on until no
false positive is left. The first level that a host does not pass tells whether it is listed: exactly, for every host
of the corpus, and without a join. Levels are built by Spark (`bit_or` per 64-bit word) and read as literals.

A level has `BITS_PER_KEY` bits per key, so the first takes 1.5 bytes per listed host and the others less together.
Beyond `max_bytes` for a level the list is too large to be broadcast, and membership is found by a join instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.llm.bloom import positions, set_words
from ferryload.llm.common import Workspace, ascii_lower

BITS_PER_KEY = 12
MAX_FILTER_BYTES = 16 << 20
MAX_LEVELS = 64

# The given rules (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Words that put a host on the block list when they stand between dots or hyphens of its name.
LISTED_WORDS = ["adult", "ads", "bets", "casino", "farm", "free", "pills", "poker", "spam", "track", "viagra", "xxx"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ://."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


class Level:
    """A Bloom filter as an array literal of 64-bit words."""

    def __init__(self, number: int, bits: int, words: dict[int, int]):
        self.number, self.bits = number, bits
        # one text literal, which the optimizer folds into an array once
        self.words = ",".join(str(words.get(i, 0)) for i in range(bits // 64))

    def passes(self, key: Column) -> Column:
        array = F.split(F.lit(self.words), ",").cast("array<bigint>")
        tests = [F.getbit(F.get(array, F.shiftright(at, 6).cast("int")), at % 64) == 1 for at in positions(key, self.number, self.bits)]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def build_level(keys: DataFrame, number: int, count: int) -> Level:
    """The filter of ``keys`` (key): bits are set by an aggregate per word, so the result has at most bits / 64 rows."""
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
    return Level(number, bits, set_words(keys, number, bits))


def listed_by(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: levels 1, 3, ... hold listed keys, levels 2, 4, ... the others."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(answer)
    return answer


def cascade(universe: DataFrame, work: Workspace, max_bytes: int = MAX_FILTER_BYTES) -> list[Level] | None:
    """Levels for ``universe`` (key, listed); None where a level would exceed ``max_bytes``."""
    levels: list[Level] = []
    inside, wanted = universe, True
    while len(levels) < MAX_LEVELS:
        number = len(levels) + 1
        keys = inside.where(F.col("listed") == wanted)
        count = keys.count()
        if count * BITS_PER_KEY > max_bytes * 8:
            return None
        if not count:
            return levels or [build_level(keys, 1, 0)]
        levels.append(build_level(keys, number, count))
        # of the other side, what passes this level has to be told apart by the next
        inside = work.write(inside.where((F.col("listed") == wanted) | levels[-1].passes(F.col("key"))), f"level{number}")
        wanted = not wanted
    raise RuntimeError("the cascade did not end")


def word_listed(host: Column, words: list[str] = LISTED_WORDS) -> Column:
    return host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, listed=word_listed, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    listed: Column function that says of a distinct host whether it is on the list, or a DataFrame (host) that is the
    list. The longest fitting rule decides; without one, listed hosts are blocked and all others allowed. A null url or
    one without :// has an empty host, which is never listed. Repeated rows are judged alike; null ids are carried.
    """
    work = Workspace(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("_url"))
    parts = pages.select("page_id", F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    hosts = parts.select(F.col("host").alias("key")).distinct()
    if isinstance(listed, DataFrame):
        on_list = listed.select(F.col("host").alias("key")).where("key is not null").distinct().withColumn("listed", F.lit(True))
        universe = hosts.join(on_list, "key", "left").select("key", (F.coalesce("listed", F.lit(False)) & (F.col("key") != "")).alias("listed"))
    else:
        universe = hosts.select("key", (listed(F.col("key")) & (F.col("key") != "")).alias("listed"))
    universe = work.write(universe, "universe")
    levels = cascade(universe, work, max_bytes)
    if levels is None:
        found = parts.join(universe.where("listed").withColumnRenamed("key", "host"), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        found = parts.withColumn("listed", listed_by(levels, F.col("host")))
    found = found.withColumn("by", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("by.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"))
