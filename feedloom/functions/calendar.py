"""ISO weeks and the windows they stand for. Times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """``YYYY-Www`` of a date or time; null for null."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_monday(week: Column) -> Column:
    """Monday of ``YYYY-Www``; null if the week is malformed or does not exist in that year."""
    year, number = F.regexp_extract(week, r"^(\d{4})-W(\d{2})$", 1), F.regexp_extract(week, r"^(\d{4})-W(\d{2})$", 2)
    fourth = F.try_to_timestamp(F.concat(F.nullif(year, F.lit("")), F.lit("-01-04")), F.lit("yyyy-MM-dd")).cast("date")
    first = F.date_sub(fourth, F.weekday(fourth))
    monday = F.date_add(first, (F.nullif(number, F.lit("")).cast("int") - 1) * 7)
    return F.when(iso_week(monday) == week, monday)


def is_iso_week(week: Column) -> Column:
    return F.coalesce(week_monday(week).isNotNull(), F.lit(False))


def week_window(week: Column, weeks: int = 8) -> tuple[Column, Column]:
    """(start, end), both inclusive: the end is the week's Sunday, its last microsecond; the start is midnight of the
    Sunday ``weeks`` weeks before, so the window spans 7 * ``weeks`` + 1 days."""
    sunday = F.date_add(week_monday(week), 6)
    end = sunday.cast("timestamp") + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")
    return F.date_sub(sunday, 7 * weeks).cast("timestamp"), end


def last_completed_week(now: Column, zone: str = "Asia/Kolkata") -> Column:
    """The ISO week seven days before ``now`` as a wall clock in ``zone`` shows it."""
    return iso_week(F.from_utc_timestamp(now, zone) - F.expr("INTERVAL 7 DAYS"))


def week_range(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """The rows of ``ranges`` for each week from ``first`` to ``last``, in a column ``week``; none if they descend."""
    days = F.sequence(week_monday(F.col(first)), week_monday(F.col(last)), F.expr("INTERVAL 7 DAYS"))
    ascending = week_monday(F.col(first)) <= week_monday(F.col(last))
    return ranges.withColumn("week", F.explode(F.transform(F.when(ascending, days).otherwise(F.array().cast("array<date>")), iso_week)))


def quarter_label(week: Column) -> Column:
    """``Q2 2026`` of a week, thirteen weeks to a quarter and the rest to the last; else ``Current Period``."""
    year, number = F.regexp_extract(week, r"^(\d{4})-W(\d{1,2})$", 1), F.nullif(F.regexp_extract(week, r"^(\d{4})-W(\d{1,2})$", 2), F.lit("")).cast("int")
    quarter = F.when(number.isNotNull(), F.least(F.floor((number - 1) / 13) + 1, F.lit(4)))
    return F.coalesce(F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year), F.lit("Current Period"))
