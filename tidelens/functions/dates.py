"""Event-aligned time bins as column expressions.

Every bin uses floor: integer division truncates toward zero and would merge the bins on
both sides of the event.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_since(ts: Column, event: str) -> Column:
    """Whole days from the event's midnight."""
    return F.datediff(F.to_date(ts), F.lit(event).cast("date"))


def rel_bin(ts: Column, event: str, days: int = 7) -> Column:
    """Index of the bin of `days` days, 0 beginning on the event's day."""
    return F.floor(days_since(ts, event) / days).cast("int")


def week_start(ts: Column) -> Column:
    """Monday of the calendar week."""
    return F.date_trunc("week", ts).cast("date")


def event_bin(ts: Column, event: str, weeks: int = 4) -> Column:
    """Bin of `weeks` weeks from the event, by the Monday of the week (the fraction counts)."""
    return F.floor((F.datediff(week_start(ts), F.lit(event).cast("date")) / 7.0) / weeks).cast("int")


def month_bin(week: Column, size: int = 4) -> Column:
    """Sign-aware bin of a relative week: -1 stands alone, 0..size-1 is 0."""
    return F.when(week >= 0, F.floor(week / size)).otherwise(F.floor((week + 1) / size) - 1).cast("int")


def quarter_bin(week: Column, size: int = 12, low: int = -8, high: int = 12) -> Column:
    return F.greatest(F.least(F.floor(week / size), F.lit(high)), F.lit(low)).cast("int")


def quarter_index(ts: Column, first_year: Column | int) -> Column:
    """Quarters since the first quarter of first_year."""
    return ((F.year(ts) - first_year) * 4 + F.quarter(ts) - 1).cast("int")


def period_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def run_bucket(version: Column, size: int = 10_000) -> Column:
    """Block of run ids that a version belongs to."""
    return F.floor(version / size).cast("long")


def is_workday(ts: Column) -> Column:
    return F.weekday(ts) < 5


def parse_mixed(text: Column) -> Column:
    """Timestamp of an ISO string with or without time, fraction or T; null if it is none."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
