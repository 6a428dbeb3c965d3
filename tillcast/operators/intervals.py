"""Empirical forecast intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach
from .running import pooled_quantiles


def residual_interval(backtest: DataFrame, by, lo: float = 0.1, hi: float = 0.9, pooled: bool = False) -> DataFrame:
    """Exact ``lo`` and ``hi`` quantiles of the backtest residuals of each group.

    Groups inside one series hold at most its backtest rows and are aggregated
    directly. Set ``pooled`` for groups that span series, such as model and
    horizon: they grow with the data and are ranked across the cluster instead.
    """
    residuals = backtest.select(*by, (F.col("y") - F.col("yhat")).alias("_residual"))
    if pooled:
        return pooled_quantiles(residuals, "_residual", {"q_lo": lo, "q_hi": hi}, by)
    limits = F.percentile("_residual", F.array(F.lit(lo), F.lit(hi)))
    return residuals.groupBy(*by).agg(limits.alias("_q")).select(
        *by, F.col("_q")[0].alias("q_lo"), F.col("_q")[1].alias("q_hi"))


def with_interval(forecasts: DataFrame, quantiles: DataFrame, by, level: Column | None = None,
                  least: Column | None = None) -> DataFrame:
    """Add ``lo`` and ``hi``; groups without residuals get null limits.

    Quantiles of relative residuals are multiplied with ``level``; limits do not
    fall below ``least``.
    """
    level = F.lit(1.0) if level is None else level
    lo, hi = (F.col("yhat") + F.col(q) * level for q in ("q_lo", "q_hi"))
    if least is not None:  # greatest would put it in the place of a null
        lo, hi = (F.when(limit.isNotNull(), F.greatest(limit, least)) for limit in (lo, hi))
    return attach(forecasts, quantiles, by, "left").select(*forecasts.columns, lo.alias("lo"), hi.alias("hi"))


def coverage(df: DataFrame, by=()) -> DataFrame:
    """Share of actual values inside their interval."""
    inside = F.col("y").between(F.col("lo"), F.col("hi"))
    return df.groupBy(*by).agg(
        F.count(inside).alias("n"), F.avg(inside.cast("double")).alias("coverage"))
