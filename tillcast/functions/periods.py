"""Calendar periods: every period is keyed by the date of its first day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month")
SEASONS = {"day": 7, "week": 52, "month": 12}  # periods after which sales look alike


def _check(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    return grain


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def period_start(date: Column, grain: str) -> Column:
    """First day of the period holding ``date``; weeks start on Monday."""
    if _check(grain) == "day":
        return date.cast("date")
    return F.trunc(date, "MM" if grain == "month" else "WEEK")


def shift(date: Column, count, grain: str) -> Column:
    """The period ``count`` periods later; negative counts go back."""
    count = _as_column(count).cast("int")
    if _check(grain) == "month":
        return F.add_months(date, count)
    return F.date_add(date, count * F.lit(7 if grain == "week" else 1))


def periods_between(first: Column, last: Column, grain: str) -> Column:
    """Whole periods from ``first`` to ``last``, both period starts."""
    if _check(grain) == "month":
        return ((F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)).cast("int")
    return (F.date_diff(last, first) / F.lit(7 if grain == "week" else 1)).cast("int")


def period_range(first: Column, last: Column, grain: str) -> Column:
    """Array of the period starts from ``first`` to ``last``, both included."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[_check(grain)]
    return F.sequence(first, last, F.expr(step))


def complete_bounds(df: DataFrame, date: str, grain: str) -> tuple[Column, Column]:
    """First and last period fully covered by the dates in ``df``.

    Read in one job over one column of ``df`` and given as literal dates, so that
    they reach the scans of the plans that use them. Null for an empty ``df``.
    """
    low = F.min(date).cast("date")
    high = F.max(date).cast("date")
    first = F.when(period_start(low, grain) == low, low).otherwise(shift(period_start(low, grain), 1, grain))
    last = shift(period_start(F.date_add(high, 1), grain), -1, grain)
    found = df.agg(first.alias("first"), last.alias("last")).first()
    return F.lit(found["first"]).cast("date"), F.lit(found["last"]).cast("date")
