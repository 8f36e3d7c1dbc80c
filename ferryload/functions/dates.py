"""Date and month expressions (F1-F13). All are built-in Column expressions.

Spark 4 runs in ANSI mode, so everything that coerces uses the ``try_`` form:
bad input becomes NULL instead of stopping the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryload.fixed_values import SERIAL_DATE_EPOCH
from ferryload.functions.casting import cast_or_null


def spark_pattern(pattern: str) -> str:
    """Rewrite a load-script date pattern: upper-case year and day letters become Spark's."""
    return pattern.replace("Y", "y").replace("D", "d")


def add_months(date: Column, months: int | Column) -> Column:
    """month shift; the day is clipped to the end of a shorter month, never moved to it."""
    return F.add_months(date, months)


def format_date(value: Column, pattern: str) -> Column:
    """``Date(x, 'fmt')`` as text."""
    return F.date_format(value, spark_pattern(pattern))


def to_date(value: Column) -> Column:
    """``Date(x)`` without a format."""
    return value.try_cast("date")


def month_start(value: Column) -> Column:
    """first day of the month, as a date."""
    return F.trunc(value, "MM")


def month_name(value: Column) -> Column:
    """short English month name, ``Jan`` to ``Dec``.

    Built from the month number, so it does not depend on the session locale.
    """
    return F.element_at(
        F.split(F.lit("Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"), ","), F.month(value)
    )


def make_date(year: Column, month: Column, day: Column) -> Column:
    """date from parts; impossible parts give NULL."""
    text = F.format_string(
        "%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int")
    )
    complete = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(complete, text.try_cast("date"))


def date_part(value: Column, part: str) -> Column:
    """year, month, day, hour, minute or second as an integer."""
    parts = {
        "year": F.year, "month": F.month, "day": F.dayofmonth,
        "hour": F.hour, "minute": F.minute, "second": F.second,
    }
    return parts[part.lower()](value)


def today(as_of: str | None = None) -> Column:
    """F8: ``Today()``. Give ``as_of`` to make a run repeatable."""
    return F.lit(as_of).cast("date") if as_of else F.current_date()


def now(as_of: str | None = None) -> Column:
    """F8: ``Now()``. Give ``as_of`` to make a run repeatable."""
    return F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()


def to_timestamp(value: Column) -> Column:
    """``Timestamp(x)``; unreadable text gives NULL."""
    return value.try_cast("timestamp")


def yyyymm_to_date(value: Column) -> Column:
    """month number such as 201305 (integer or text) to the first day of that month."""
    text = F.trim(value.cast("string"))
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.lit("01"))
    return F.when(text.rlike(r"^\d{6}$"), iso.try_cast("date"))


def shift_yyyymm(value: Column, months: int, as_text: bool = True) -> Column:
    """month number moved by ``months``, as ``yyyyMM`` text or as a date."""
    shifted = F.add_months(yyyymm_to_date(value), months)
    return F.date_format(shifted, "yyyyMM") if as_text else shifted


def month_region_key(region: Column, month: Column, months: int = 12) -> Column:
    """``region_yyyyMM`` with the month moved by ``months``; NULL if either part is NULL."""
    return F.concat(region, F.lit("_"), F.date_format(F.add_months(month, months), "yyyyMM"))


def serial_to_date(value: Column) -> Column:
    """day serial to date. The fraction is cut towards zero; unreadable values give NULL."""
    days = cast_or_null(value, "double").try_cast("int")
    return F.date_add(F.lit(SERIAL_DATE_EPOCH).cast("date"), days)
