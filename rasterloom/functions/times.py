"""Dates and times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss'Z'"]


def date_range(start: Column, end: Column) -> Column:
    """All days from start to end; none if end is earlier."""
    return F.when(end < start, F.array().cast("array<date>")).otherwise(F.sequence(F.least(start, end), F.greatest(start, end)))


def next_date(d: Column) -> Column:
    return F.date_add(d, 1)


def prev_date(d: Column) -> Column:
    return F.date_sub(d, 1)


def iso_date(s: Column) -> Column:
    return F.to_date(F.substring_index(s, "T", 1))


def to_iso(t: Column, only_date: bool = True) -> Column:
    return F.date_format(t, "yyyy-MM-dd" if only_date else "yyyy-MM-dd'T'HH:mm:ss")


def day_of_year_date(dn: Column) -> Column:
    """yyyyddd to yyyymmdd."""
    return F.date_format(F.to_date(dn.cast("string"), "yyyyDDD"), "yyyyMMdd")


def parsed(s: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS])


def is_time(s: Column) -> Column:
    return parsed(s).isNotNull()


def parse_time(s: Column) -> Column:
    """ISO date of up to ten characters, ISO date and time of more; fewer than eight are refused."""
    return F.when(F.length(s) < 8, F.raise_error(F.lit("too short for a time"))).when(F.length(s) <= 10, to_iso(parsed(s))).otherwise(to_iso(parsed(s), False))


def beijing_window(d: Column) -> tuple[Column, Column]:
    """Start and end in UTC of the product search for a day in Beijing."""
    t = d.cast("timestamp_ntz")
    return to_iso(t - F.expr("INTERVAL '8' HOUR"), False), to_iso(t + F.expr("INTERVAL '15' HOUR"), False)


def current_date() -> Column:
    """The day on which the query runs, as ISO text; one and the same for all rows."""
    return to_iso(F.current_timestamp())


def one_hour() -> Column:
    """An interval to add to times."""
    return F.expr("INTERVAL '1' HOUR")
