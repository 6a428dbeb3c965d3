"""Columns known for any date in advance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR = ("year", "month", "quarter", "week", "weekday", "days_in_month", "month_end")


def calendar_columns(date: Column) -> dict[str, Column]:
    """Calendar fields of ``date``; weekday counts from Sunday = 1, weeks are ISO."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "week": F.weekofyear(date),
        "weekday": F.dayofweek(date),
        "days_in_month": F.dayofmonth(F.last_day(date)),
        "month_end": (date == F.last_day(date)).cast("int"),
    }


def fourier_columns(position: Column, period: float, order: int) -> dict[str, Column]:
    """Sine and cosine pairs of ``position`` in a cycle of ``period`` steps."""
    columns = {}
    for k in range(1, order + 1):
        angle = F.lit(2.0 * k) * F.pi() * position / F.lit(float(period))
        columns[f"sin_{k}"] = F.sin(angle)
        columns[f"cos_{k}"] = F.cos(angle)
    return columns
