"""From source tables to a complete, dense panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.periods import complete_bounds
from ..operators.panel import densify, revenue_panel
from ..sources.sales import SalesTables


def period_bounds(tables: SalesTables, grain: str) -> tuple[Column, Column]:
    """First and last complete period of the orders; reads one column."""
    return complete_bounds(tables.orders, "o_orderdate", grain)


def dense_panel(tables: SalesTables, keys, grain: str, exclude_returns: bool = False,
                bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Revenue per series and complete period, zeros where nothing was sold."""
    bounds = bounds or period_bounds(tables, grain)
    return densify(revenue_panel(tables, keys, grain, exclude_returns, bounds), keys, grain, bounds)
