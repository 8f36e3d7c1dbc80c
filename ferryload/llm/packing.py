"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the longest permitted length are split into pieces of it; every token lands in exactly one bin.
Pieces are dealt by a hash to groups of about `group_rows`; a group is packed in one task from lengths alone (no text).

Within a group pieces come longest first. A piece goes into the open bin with the least room that holds it. If none
does, a bin is opened at the permitted length of least cost per token that can still be filled: cost is the length
plus a fixed overhead per sequence, and what can be filled is the piece and all that is yet to come. In the end each
bin is downsized to the smallest permitted length that holds its contents. Lengths are thus chosen jointly: long bins
while there is enough to fill them, short ones for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryload.llm.common import Workspace, whole
from ferryload.llm.mixing import token_count


@dataclass(frozen=True)
class Bins:
    """lengths: permitted sequence lengths in tokens. overhead: cost of a sequence besides its length. group_rows: pieces packed together."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    overhead: int = 32
    group_rows: int = 50_000


def best_fit(sizes: np.ndarray, how: Bins) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, place in the bin) of each piece, and the final length of each bin. Sizes lie between 1 and the longest length."""
    lengths = sorted(how.lengths)
    longest = lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(longest + 1)]  # open bins by their room
    open_rooms = 0  # bit r is set while some bin has room r
    used: list[int] = []
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened: list[int] = []
    to_come = int(sizes.sum())
    for i in order:
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: ((c + how.overhead) / min(c, to_come), c))
            chosen = len(used)
            used.append(0)
            opened.append(room)
        bins[i], places[i] = chosen, used[chosen]
        used[chosen] += size
        to_come -= size
        left = room - size
        if left:
            rooms[left].append(chosen)
            open_rooms |= 1 << left
    return bins, places, [next(c for c in lengths if c >= u) for u in used]


def pieces(docs: DataFrame, how: Bins) -> DataFrame:
    """doc_id, row, piece, start, n_tokens: each document in pieces of at most the longest length; none for one without tokens."""
    longest = max(how.lengths)
    rows = docs.select("doc_id", token_count(whole("text")).alias("tokens")).withColumn("row", F.monotonically_increasing_id())
    last = F.ceil(F.col("tokens") / longest).cast("int") - 1
    rows = rows.withColumn("piece", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))))
    start = (F.col("piece") * longest).cast("long")
    return rows.select("doc_id", "row", "piece", start.alias("start"), F.when(F.col("piece").isNotNull(), F.least(F.lit(longest), F.col("tokens") - start)).alias("n_tokens"))


def packed(docs: DataFrame, how: Bins = Bins()) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start (first word of the piece), n_tokens, bin_id, bin_length, bin_start.

    Tokens are words between ASCII blanks. bin_start is the piece's place in its bin, bin_length the bin's final length.
    A document without words (null, empty) gives one row with n_tokens 0 and no bin. Repeated rows are packed each for
    itself; null ids are carried; other columns are not looked at. An empty table gives an empty result. A rerun packs
    the same rows the same way as long as the input's files are the same.
    """
    work = Workspace(docs.sparkSession, "packing")
    table = work.write(pieces(docs, how), "pieces")
    groups = max(1, -(-table.where("n_tokens > 0").count() // how.group_rows))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"], ignore_index=True)
        bins, places, lengths = best_fit(frame["n_tokens"].to_numpy(), how)
        out = frame[["doc_id", "piece", "start", "n_tokens"]].copy()
        out["bin_id"] = frame["grp"].astype(str) + "-" + pd.Series(bins).astype(str)
        out["bin_length"] = np.array(lengths, np.int64)[bins]
        out["bin_start"] = places
        return out

    # ids pass through pandas as text: a null among them would turn the others into floating point
    full = table.where("n_tokens > 0").withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    schema = "doc_id string, piece int, start long, n_tokens long, bin_id string, bin_length long, bin_start long"
    done = full.groupBy("grp").applyInPandas(pack, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    none = table.where("n_tokens is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"),
                                                  F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_length"), F.lit(None).cast("long").alias("bin_start"))
    return done.unionByName(none)


def sequences(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed texts: bin_id, bin_length, text with the words of its pieces in order, joined by blanks; needs unique doc_ids.

    A bin holds at most its length in words, so a group is bounded."""
    cut = F.filter(F.split(whole("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = placed.where("bin_id is not null").join(docs.select("doc_id", "text"), "doc_id")
    parts = parts.withColumn("words", F.array_join(F.slice(cut, F.col("start").cast("int") + 1, F.col("n_tokens").cast("int")), " "))
    ordered = F.array_sort(F.collect_list(F.struct("bin_start", "words")))
    return parts.groupBy("bin_id", "bin_length").agg(F.array_join(F.transform(ordered, lambda p: p["words"]), " ").alias("text"))
