"""Seasons as (month, day) bounds, and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import as_col


def month_day(d) -> Column:
    """Sortable month-day key."""
    d = as_col(d)
    return F.month(d) * 100 + F.dayofmonth(d)


def in_season(d, start, end) -> Column:
    """Is the date inside the season? ``start``/``end`` are (month, day) pairs or key columns."""
    key, lo, hi = month_day(d), _key(start), _key(end)
    return F.when(lo <= hi, (key >= lo) & (key <= hi)).otherwise((key >= lo) | (key <= hi))


def _key(bound) -> Column:
    if isinstance(bound, tuple):
        return F.lit(bound[0] * 100 + bound[1])
    return as_col(bound)


def date_in(year, bound: tuple[int, int]) -> Column:
    """The date of a (month, day) in a year."""
    return F.make_date(as_col(year), F.lit(bound[0]), F.lit(bound[1]))


def water_year(d, start: tuple[int, int] = (10, 1)) -> Column:
    """Year in which the water year ends; ``(1, 1)`` gives calendar years."""
    d = as_col(d)
    if start == (1, 1):
        return F.year(d)
    return F.year(d) + F.when(month_day(d) >= start[0] * 100 + start[1], 1).otherwise(0)
