"""Dates and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_date(x) -> Column:
    """m/d/yy or m/d/yyyy as a date; two digits are of this century."""
    part = lambda k: F.regexp_extract(_c(x), r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", k).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, part(1), part(2)))


def month_day(code, year) -> Column:
    """month * 100 + day as a date of a year, null if there is no such day."""
    c = _c(code).cast("int")
    return F.try_to_date(F.format_string("%04d-%02d-%02d", _c(year).cast("int"), F.floor(c / 100).cast("int"), F.pmod(c, F.lit(100))))


def acquired(day, hhmm) -> Column:
    """A UTC time from a date and an unpadded hour and minute."""
    raw = F.trim(_c(hhmm).cast("string"))
    t = F.when(raw.rlike(r"^\d{1,4}$"), F.lpad(raw, 4, "0"))
    return F.try_to_timestamp(F.concat(_c(day).cast("string"), F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":00")))


def compact(x) -> Column:
    """20240131T235900Z as a time."""
    return F.try_to_timestamp(F.regexp_replace(_c(x), r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z$", "$1-$2-$3 $4:$5:$6"))


def clock_seconds(x) -> Column:
    """m:ss or h:mm:ss as seconds."""
    return F.aggregate(F.split(_c(x), ":"), F.lit(0).cast("long"), lambda a, p: a * 60 + p.try_cast("long"))


def epoch_ms(x) -> Column:
    """Epoch seconds or milliseconds as milliseconds; null unless between 2000 and 2100."""
    v = _c(x).cast("double")
    ms = F.when(F.abs(v) < 1e11, v * 1000).otherwise(v).cast("long")
    return F.when(ms.between(946684800000, 4102444800000), ms)


def block_start(year, size: int = 5) -> Column:
    return (F.floor(_c(year) / size) * size).cast("long")


def block_label(year, size: int = 5) -> Column:
    start = block_start(year, size)
    return F.concat(start.cast("string"), F.lit("-"), (start + size - 1).cast("string"))


def iso_duration(x) -> Column:
    """A signed ISO-8601 duration as seconds; null if it is none."""
    s = _c(x)
    pattern = r"^(-?)P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda k: F.coalesce(F.regexp_extract(s, pattern, k).try_cast("double"), F.lit(0.0))
    seconds = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return F.when(s.rlike(pattern), F.when(s.startswith("-"), -seconds).otherwise(seconds))


def past_year(x, now: int) -> Column:
    """A year up to now, else null."""
    return F.when(_c(x).between(1, now), _c(x))


def decade(x) -> Column:
    """The first year of a date's decade."""
    return (F.floor(F.year(_c(x)) / 10) * 10).cast("long")


def utc_day(ms) -> Column:
    """The day of epoch milliseconds in UTC, as text."""
    return F.date_format(F.date_from_unix_date(F.floor(_c(ms) / 86_400_000).cast("int")), "yyyy-MM-dd")
