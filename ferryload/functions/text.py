"""Text expressions (F14-F19, F22, F24-F26) and name builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryload.fixed_values import (
    DISPLAY_WORDS,
    LATEST_FORECAST_HINTS,
    RESERVED_WORDS,
)
from ferryload.functions.casting import cast_or_null


def ampersand(*parts: Column | str) -> Column:
    """the ``&`` operator. NULL in any part makes the result NULL."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def upper(value: Column) -> Column:
    """F15."""
    return F.upper(value)


def lower(value: Column) -> Column:
    """F15."""
    return F.lower(value)


def trim(value: Column) -> Column:
    """F15."""
    return F.trim(value)


def length(value: Column) -> Column:
    """F16: ``Len``."""
    return F.length(value)


def left(value: Column, n: int) -> Column:
    """F17."""
    return F.left(value, F.lit(n))


def right(value: Column, n: int) -> Column:
    """F17."""
    return F.right(value, F.lit(n))


def mid(value: Column, start: int, n: int | None = None) -> Column:
    """1-based substring; without ``n`` up to the end."""
    return F.substring(value, start, n if n is not None else 2**31 - 1)


def index(value: Column, part: str) -> Column:
    """1-based position of ``part``, 0 when it does not occur."""
    return F.instr(value, part)


def replace(value: Column, old: str, new: str) -> Column:
    """F19."""
    return F.replace(value, F.lit(old), F.lit(new))


def as_text(value: Column) -> Column:
    """``Text(x)``."""
    return value.cast("string")


def is_empty(value: Column) -> Column:
    """NULL or only blanks."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def is_numeric(value: Column) -> Column:
    """the value reads as a number. NULL is neither numeric nor textual."""
    return value.isNotNull() & cast_or_null(value, "double").isNotNull()


def is_textual(value: Column) -> Column:
    """a value that does not read as a number."""
    return value.isNotNull() & cast_or_null(value, "double").isNull()


def match(value: Column, *candidates: str) -> Column:
    """1-based position of the first equal candidate, 0 if none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in candidates]), value), F.lit(0)).cast("int")


def wild_match(value: Column, *patterns: str) -> Column:
    """1-based position of the first matching pattern (``*`` many, ``?`` one), ignoring case."""
    result = F.lit(0)
    for position in range(len(patterns), 0, -1):
        like = patterns[position - 1].replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        like = like.replace("*", "%").replace("?", "_")
        result = F.when(value.ilike(like), F.lit(position)).otherwise(result)
    return result


def contains_any(value: Column, tokens: list[str]) -> Column:
    """True when any token occurs anywhere in the lower-cased value."""
    return F.coalesce(F.lower(value).rlike("|".join(_literal(t) for t in tokens)), F.lit(False))


def _literal(token: str) -> str:
    return "".join(f"\\{ch}" if ch in r".^$*+?()[]{}|\/" else ch for ch in token)


# --- names ------------------------------------------------------------------
# The patterns that define a normalised name, in order of use.
LEADING_PERCENT = r"^%+"
PATH_AND_SPACE = r"[./\\\s]+"
NOT_WORD = r"[^0-9A-Za-z_]+"
ACRONYM_EDGE = r"(?<=[A-Z])(?=[A-Z][a-z])"
CAMEL_EDGE = r"(?<=[a-z0-9])(?=[A-Z])"
SHORT_HEAD = r"^([a-z]{1,2})_([a-z])(?=_)"
NAME_SEPARATORS = r"[%_/.\-]+"
FORMAT_SUFFIX = r"\s*\([^)]*\)\s*$"
SOURCE_CALL = r"(?i)\{\{\s*source\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}"
LAST_PATH_PART = r"([^/\\]+?)(?:\.[A-Za-z0-9_]+)?$"


def snake_words(value: Column) -> Column:
    """Lower-case words joined with ``_``; empty names become ``unnamed``."""
    name = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    name = F.regexp_replace(name, LEADING_PERCENT, "")
    for separator in (PATH_AND_SPACE, NOT_WORD, ACRONYM_EDGE, CAMEL_EDGE, "_+"):
        name = F.regexp_replace(name, separator, "_")
    name = F.lower(F.regexp_replace(name, "^_+|_+$", ""))
    return F.regexp_replace(F.regexp_replace(name, SHORT_HEAD, "$1$2"), "^$", "unnamed")


def column_name(value: Column, reserved_suffix: str = "_col") -> Column:
    """Snake case plus the rules for leading digits and reserved words.

    Written as one chain, so that the plan holds the name once and not once per rule.
    """
    name = F.regexp_replace(snake_words(value), r"^(?=\d)", "col_")
    return F.regexp_replace(name, "^(" + "|".join(RESERVED_WORDS) + ")$", "$1" + reserved_suffix)


def title_case(value: Column) -> Column:
    """Every run of letters starts with a capital, also after a digit or an apostrophe."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def business_name(value: Column) -> Column:
    """K5: readable name of a column: separators and camel case become spaces."""
    name = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), NAME_SEPARATORS, " "))
    name = F.regexp_replace(F.regexp_replace(name, CAMEL_EDGE, " "), r"\s+", " ")
    return title_case(F.regexp_replace(name, "^$", "unnamed"))


def display_name(value: Column) -> Column:
    """K5: KPI display name; known abbreviations are written out."""
    planning = contains_any(value, LATEST_FORECAST_HINTS)

    def written_out(word: Column) -> Column:
        text = title_case(word)
        for short, full in DISPLAY_WORDS.items():
            text = F.when(word == short, F.lit(full)).otherwise(text)
        return F.when((word == "lf") & planning, F.lit("Latest Forecast")).otherwise(text)

    return F.array_join(F.transform(F.split(snake_words(value), "_"), written_out), " ")


def source_identity(path: Column) -> Column:
    """Logical table name of a path, ``lib://`` reference, quoted name, name with a format or source call."""
    text = F.trim(F.coalesce(path, F.lit("")))
    called = F.regexp_extract(text, SOURCE_CALL, 1)
    text = F.regexp_replace(F.when(called != "", called).otherwise(text), FORMAT_SUFFIX, "")
    text = F.regexp_replace(F.trim(text), r"^[\[\]]+|[\[\]]+$", "")
    text = F.trim(F.regexp_replace(text, "^['\"]+|['\"]+$", ""))
    last = F.regexp_extract(text, LAST_PATH_PART, 1)
    return F.regexp_replace(F.lower(F.when(last == "", text).otherwise(last)), "[^a-z0-9]+", "")


def is_key_name(field: Column) -> Column:
    """Names that end with id or key, or start with ``%``."""
    return F.lower(field).rlike(r"(id|key)$|^%")
