"""Exact money arithmetic on sales lines."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
SUMMED = "decimal(38,4)"


def money(column) -> Column:
    """A price or rate held at two decimals, as decimal."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast(MONEY)


def hundredths(column: str) -> Column:
    """A column held at two decimals, as a whole number of hundredths.

    Sums of whole numbers are exact like sums of decimals and several times
    cheaper, so the large facts are added up this way. Finer values are rounded as
    ``money`` rounds them: half up, by their decimal digits.
    """
    return (money(column) * 100).cast("bigint")


def finer(column: str) -> Column:
    """Whether a value has more than two decimals, so that ``money`` rounds it."""
    return money(column).cast("double") != F.col(column).cast("double")


def net_units(gross: Column, discount: Column) -> Column:
    """Net revenue in ten-thousandths, from hundredths of price and discount."""
    return gross * (F.lit(100) - discount)


def sum_units(units: Column) -> Column:
    """Sum of whole numbers, as decimal.

    The upper and the lower bits are summed apart: each stays inside 64 bits for
    groups of trillions of lines, and sums of 64-bit numbers are cheaper than
    sums of decimals.
    """
    upper, lower = F.sum(F.shiftright(units, 20)), F.sum(units.bitwiseAND(F.lit(2**20 - 1)))
    return (upper.cast("decimal(20,0)") * F.lit(2**20) + lower.cast("decimal(20,0)")).cast("decimal(28,0)")


def from_units(total: Column, decimals: int) -> Column:
    """A sum of whole units as an amount with ``decimals`` decimals."""
    return total.cast("decimal(34,0)") * F.lit(Decimal(1).scaleb(-decimals))


def with_revenue(df: DataFrame) -> DataFrame:
    """Add ``revenue``, the exact net amount of each sales line."""
    return df.withColumn("revenue", money("gross") * (F.lit(1) - money("discount")))


def exact_sum(column) -> Column:
    """Sum of an amount with four decimals, the same in any row order."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(SUMMED))
