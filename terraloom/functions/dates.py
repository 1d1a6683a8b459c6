"""Date expressions of the archive tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unpadded(day: Column) -> Column:
    return F.concat_ws("-", F.year(day), F.month(day), F.day(day))


def days_in_year(day: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))


def parse_date(text: Column) -> Column:
    """A date written with '-', '.' or ' ' between its parts; NULL if it is none."""
    return F.coalesce(*(F.try_to_date(text, f) for f in ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy MM dd")))


def ordered(first: Column, second: Column) -> tuple[Column, Column]:
    """Two dates as (earlier, later)."""
    return F.least(first, second), F.greatest(first, second)
