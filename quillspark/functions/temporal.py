"""Clock arithmetic. The evaluation time is always an argument, in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(now: datetime) -> Column:
    """A literal without a time zone."""
    return F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def epoch(ts: Column) -> Column:
    """Seconds since 1970, whole."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def in_effect(start: Column, end: Column, now: Column) -> Column:
    """start <= now < end; a null end is open."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(end > now, F.lit(True))


def iso_week_key(ts: Column) -> Column:
    """``YYYY-Www``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def is_clock_time(text: Column) -> Column:
    return F.coalesce(text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.lit(False))


def whole_number(text: Column, low: int, high: int) -> Column:
    """The whole number that a text spells, blanks around it and zeros after a point allowed; null outside ``low`` to ``high``."""
    number = F.expr("CAST(NULL AS DECIMAL(38, 0))")
    number = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(F.trim(text), r"\..*$", "").try_cast("decimal(38,0)")).otherwise(number)
    return F.when(number.between(low, high), number.cast("int"))


def is_quiet(start: Column, end: Column, clock: Column) -> Column:
    """Whether ``HH:MM`` lies in quiet hours; equal ends are always quiet, and hours may pass midnight."""
    inside = F.when(start < end, (clock >= start) & (clock < end)).otherwise((clock >= start) | (clock < end))
    return F.when(start.isNull() | end.isNull(), False).when(start == end, True).otherwise(inside)


def day_window(now: datetime, days: int = 0) -> tuple[datetime, datetime]:
    start = now.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=days)
    return start, start + timedelta(days=1)


def week_window(now: datetime, weeks: int = 0) -> tuple[datetime, datetime]:
    """Monday to Monday."""
    start = now.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=7 * weeks - now.weekday())
    return start, start + timedelta(days=7)
