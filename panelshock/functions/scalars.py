"""Column formulas of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(date: str) -> Column:
    return F.month(F.col(date))


def weekday_of(date: str) -> Column:
    """Monday is 0."""
    return F.weekday(F.col(date))


def week_start(date: Column | str) -> Column:
    """Monday of the week, as a date."""
    day = F.col(date) if isinstance(date, str) else date
    return F.date_sub(day, F.weekday(day))


def day_number(date: str) -> Column:
    return F.unix_date(F.col(date))


def in_season(date: str, months: Sequence[int]) -> Column:
    return F.month(F.col(date)).isin(*months)


def percent_deviation(value: Column, base: Column) -> Column:
    """100 * (value - base) / base in double arithmetic."""
    base = base.cast("double")
    return F.lit(100.0) * (value.cast("double") - base) / base


def average_price(sales: str, count: str) -> Column:
    """Sales per unit, NULL when either is missing or the count is zero."""
    return F.try_divide(F.col(sales).cast("double"), F.col(count).cast("double"))


def exposure_flag(peak: Column, threshold: float, complete: Column) -> Column:
    """1 when a valid window reaches the threshold, 0 on a fully observed day without
    one, NULL otherwise."""
    return F.when(peak >= threshold, 1).when(complete, 0).cast("int")


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def sum_unless_missing(c: str) -> Column:
    """Sum that is NULL as soon as one input of the group is missing."""
    return F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c))
