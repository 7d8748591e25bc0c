"""Date rules; dates stay ISO strings, and what depends on today takes an as-of parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Milliseconds of a year of 365.25 days.
YEAR_MS = 31_557_600_000


def _month(number: Column, letters: int | None = None) -> Column:
    names = F.array(*[F.lit(m[:letters] if letters else m) for m in MONTHS])
    return F.get(names, number - 1)


def dot_net_date(value: Column) -> Column:
    """``/Date(ms+hhmm)/`` as the ISO date at that offset."""
    pattern = r"/Date\((\d+)([+-]\d{4})?\)/"
    part = lambda i: F.regexp_extract(value, pattern, i)
    sign = F.when(F.startswith(part(2), F.lit("-")), -1).otherwise(1)
    # Most stamps have no offset; reading a number in an empty text costs an exception inside, many times the rest.
    minutes = F.when(part(2) == "", 0).otherwise(sign * (F.substring(part(2), 2, 2).cast("int") * 60 + F.substring(part(2), 4, 2).cast("int")))
    days = F.floor((part(1).try_cast("bigint") + minutes * 60_000) / 86_400_000)
    return F.when(part(1) != "", F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"))


def days_before(date: Column, days: int) -> Column:
    return F.date_sub(date.cast("date"), days).cast("string")


def clean_date(value: Column) -> Column:
    """First ten characters; blank and the 1900 placeholder are none."""
    return F.when((F.trim(value) != "") & ~F.startswith(value, F.lit("1900-01-01")), F.substring(value, 1, 10))


def age_days(timestamp: Column, as_of: Column) -> Column:
    """Days from a timestamp text to ``as_of``; infinite where it can't be read."""
    then = F.unix_millis(F.try_to_timestamp(timestamp))
    return F.coalesce((F.unix_millis(as_of) - then) / 86_400_000, F.lit(float("inf")))


def _parts(date: Column) -> tuple[Column, Column, Column, Column]:
    parts = F.split(date, "-")
    year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
    number = month.try_cast("int")
    good = (F.size(parts) == 3) & number.between(1, 12) & day.try_cast("int").isNotNull()
    return good, year, number, day.try_cast("int")


def format_date(date: Column) -> Column:
    """``3 May 2025``; the day isn't checked against the month, other texts pass through."""
    good, year, month, day = _parts(date)
    return F.when(good, F.concat_ws(" ", day.cast("string"), _month(month), year)).otherwise(date)


def short_date(date: Column) -> Column:
    """``3 May``."""
    good, _, month, day = _parts(date)
    return F.when(good, F.concat_ws(" ", day.cast("string"), _month(month, 3))).otherwise(date)


def month_label(date: Column) -> Column:
    """``May 2025`` from a date or a month."""
    parts = F.split(date, "-")
    number = F.get(parts, F.lit(1)).try_cast("int")
    return F.when(number.between(1, 12), F.concat_ws(" ", _month(number), F.get(parts, F.lit(0)))).otherwise(date)


def dotted_date(text: Column) -> Column:
    """``29.8.2022`` as ``29 August 2022``; other texts pass through."""
    pattern = r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    iso = F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(text.rlike(pattern), let(iso, format_date)).otherwise(text)


def service_years(start: Column, as_of: Column) -> Column:
    """Years to one decimal place, whole ones without it."""
    from .numbers import shown_float

    millis = F.unix_millis(as_of) - F.unix_millis(F.try_to_timestamp(start))
    return shown_float(F.floor(millis / YEAR_MS * 10 + 0.5) / 10)


def feed_timestamp(date: Column) -> Column:
    return F.concat(date, F.lit("T00:00:00Z"))
