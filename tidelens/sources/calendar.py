"""Calendars and event-aligned windows, generated from what a table covers instead of stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import rel_bin


def span(df: DataFrame, ts: str) -> DataFrame:
    """One row (first, last): the first and last day of a table."""
    return df.agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last"))


def _days(covered: DataFrame, start: Column, end: Column, step: str) -> DataFrame:
    """(day) from start to end, columns of a span; none for an empty table."""
    return covered.where("first IS NOT NULL").select(F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias("day"))


def every_28_days(covered: DataFrame, event: str, weeks_before: int, weeks_after: int) -> DataFrame:
    """From so many weeks before the event to so many after it, both ends included, as far as the windows meet the span."""
    e = F.lit(event).cast("date")
    out = covered.crossJoin(_days(covered, F.date_sub(e, 7 * weeks_before), F.date_add(e, 7 * weeks_after), "28 days"))  # one row
    return out.where((F.date_add("day", 28) > F.col("first")) & (F.col("day") <= F.col("last"))).select("day")


def around(covered: DataFrame, event: str, window: int) -> DataFrame:
    """Window bounds that meet the event: whole windows before it within the span, one more than the whole ones after it."""
    e = F.lit(event).cast("date")
    before = F.floor(F.datediff(e, "first") / window).cast("int")
    after = F.floor(F.datediff("last", e) / window).cast("int") + 1
    return _days(covered, F.date_sub(e, before * window), F.date_add(e, after * window), f"{window} days")


def monthly(covered: DataFrame) -> DataFrame:
    """The first days of the months of a span."""
    return _days(covered, F.trunc("first", "month"), F.trunc("last", "month"), "1 month")


def month_windows(covered: DataFrame, days: int) -> DataFrame:
    """(day_from, day_to): each month's first day and the day so many days later, which may lie in the next month."""
    return monthly(covered).select(F.col("day").alias("day_from"), F.date_add("day", days).alias("day_to"))


def calendar(covered: DataFrame) -> DataFrame:
    """(day, year) of every day of a span."""
    return _days(covered, F.col("first"), F.col("last"), "1 day").select("day", F.year("day").alias("year"))


def with_counts(days: DataFrame, df: DataFrame, start: Column, key: str = "day", name: str = "n") -> DataFrame:
    """days with the number of df's rows whose window or day starts there, 0 where there is none; df is counted first."""
    counts = df.groupBy(start.alias("_start")).agg(F.count("*").alias("_n"))
    return days.join(counts, F.col(key) == F.col("_start"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_start", "_n")


def windows(df: DataFrame, ts: str, event: str, days: int = 28, name: str = "win28") -> DataFrame:
    """df with the number of its window: one scan in place of one query per window."""
    return df.withColumn(name, rel_bin(F.col(ts), event, days))
