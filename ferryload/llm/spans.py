"""Places of pattern matches as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACES = "array<struct<start:bigint,end:bigint>>"


def no_places() -> Column:
    return F.array().cast(_PLACES)


def places(text: Column, pattern: Column | str) -> Column:
    """Start and end (code points, end exclusive) of the leftmost non-overlapping matches of a pattern that never matches
    nothing: the pieces between the matches and the matches themselves alternate, so their lengths add up to positions."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(pieces, matches, lambda piece, match: F.struct(F.length(piece).alias("gap"), F.length(match).alias("size")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), no_places().alias("out"))

    def step(state, s):
        start = state["at"] + s["gap"]
        end = start + s["size"]
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(steps, begin, step, lambda state: state["out"])
