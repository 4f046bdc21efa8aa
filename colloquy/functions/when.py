"""Times and ages as Column builders. Every "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: days in which what is recent fades.
RECENT = 120.0

#: How nearness in time fades, and where it ends.
FADE_MINUTES, CUTOFF_HOURS = 90.0, 48.0


def seconds(raw: Column) -> Column:
    """Epoch seconds of a raw time, null where it isn't a number."""
    value = F.expr("try_cast(null as double)") if raw is None else raw.cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def shown(raw: Column, zone: str = "UTC") -> Column:
    """Minutes-precise local time, or unknown."""
    moment = F.from_utc_timestamp(F.timestamp_seconds(seconds(raw)), zone)
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm"), F.lit("unknown"))


def nearness(a: Column, b: Column) -> Column:
    """exp(-minutes / 90) of the distance, 0 beyond 48 hours and where a time is missing."""
    minutes = F.abs(a - b) / 60.0
    return F.coalesce(F.when(minutes <= CUTOFF_HOURS * 60, F.exp(-minutes / FADE_MINUTES)), F.lit(0.0))


def age_days(now: Column, then: Column) -> Column:
    return (now - then) / 86400.0


def business_days(start: Column, end: Column) -> Column:
    """Weekdays after start up to and including end; 0 if end is not later.

    Whole weeks have five; the rest of up to six days is counted from start's weekday.
    """
    days = F.datediff(end, start)
    first = F.weekday(start)  # Monday is 0
    rest = days % 7
    extra = sum(((F.lit(k) <= rest) & ((first + k) % 7 < 5)).cast("int") for k in range(1, 7))
    return F.when(days > 0, F.floor(days / 7) * 5 + extra).otherwise(0).cast("bigint")


def human_age(days: Column) -> Column:
    """An age in words, by its largest unit."""
    hours = days * 24
    return F.when(days.isNull(), "unknown").when(hours < 1, "just now").when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h"))).when(days < 14, F.concat(F.floor(days).cast("string"), F.lit("d"))).otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit("w")))


def bucket(days: Column, step: int) -> Column:
    """The multiple of step that has been reached."""
    return (F.floor(days / step) * step).cast("bigint")


def instant(text: Column, zone: str) -> Column:
    """An ISO 8601 time in seconds since 1970; one without an offset is in the given zone. Null if it is none."""
    shape = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?\s*$"
    part = lambda k, otherwise: F.coalesce(F.nullif(F.regexp_extract(text, shape, k), F.lit("")), F.lit(otherwise))
    offset = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, shape, 4), "^Z$", "+00:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    whole = F.concat(part(1, ""), F.lit("T"), part(2, "00:00"), part(3, ":00"), F.when(offset != "", offset).otherwise(zone))
    return F.when(text.rlike(shape), F.unix_micros(F.try_to_timestamp(whole)) / 1e6)


def workdays_before(day: Column, count: int) -> Column:
    """The last working days before a date, in order."""
    weeks = F.sequence(F.date_sub(day, 7 * (count // 5 + 2)), F.date_sub(day, 1))
    working = F.filter(weeks, lambda d: F.weekday(d) < 5)
    return F.slice(working, -count, count)


def clock_in(ts: Column, zone: str) -> Column:
    """Hour and minute of a time in a zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros((ts * 1e6).cast("long")), zone), "HH:mm")


def minute_of(clock: Column) -> Column:
    """The minute of the day of a clock such as 08:45; null if it is none."""
    shape = r"^\s*([01]?\d|2[0-3]):([0-5]\d)\s*$"
    return F.when(clock.rlike(shape), F.regexp_extract(clock, shape, 1).cast("int") * 60 + F.regexp_extract(clock, shape, 2).cast("int"))


def recency(days: Column) -> Column:
    """From 1 down, by e in 120 days."""
    return F.exp(-F.abs(days) / RECENT)
