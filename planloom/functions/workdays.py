"""Working-day calendar in closed form, so that no row loops over days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_working_day(day: Column) -> Column:
    wd = F.weekday(day)
    return F.when(wd == 5, F.date_add(day, 2)).when(wd == 6, F.date_add(day, 1)).otherwise(day)


def add_working_days(day: Column, n: Column) -> Column:
    """Advance n working days; n <= 0 leaves the date alone."""
    wd = F.weekday(day)
    base = F.when(wd == 5, F.date_sub(day, 1)).when(wd == 6, F.date_sub(day, 2)).otherwise(day)
    weekends = F.floor((F.weekday(base) + n) / 5) * 2
    return F.when(n <= 0, day).otherwise(F.date_add(base, (n + weekends).cast("int")))


def _weekdays_since_monday(day: Column) -> Column:
    """Weekdays from a fixed Monday up to and including the day."""
    k = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)) + 1, F.lit(5))


def working_days_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]; zero when the end is not after the start."""
    return F.greatest(
        F.lit(0), _weekdays_since_monday(end) - _weekdays_since_monday(start)
    ).cast("int")


# The date spellings accepted, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "d/M/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy"]


def parse_date(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)).cast("date") for f in DATE_FORMATS])
