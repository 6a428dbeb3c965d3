"""Simple forecasts every model has to beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import periods_between, shift
from .features import rolling_column, series_window

BASELINES = ("seasonal_naive", "moving_average", "linear_trend")


def seasonal_naive(df: DataFrame, keys, season: int) -> DataFrame:
    """One step ahead: the value one season back."""
    return df.withColumn("yhat", F.lag("y", season).over(series_window(keys)))


def moving_average(df: DataFrame, keys, width: int) -> DataFrame:
    """One step ahead: the trailing mean; width 1 repeats the last value."""
    return df.withColumn("yhat", rolling_column(keys, "y", width, "mean"))


def linear_trend(df: DataFrame, keys, grain: str, train_end: Column | None = None) -> DataFrame:
    """Least-squares line of each series over the period number.

    The period number counts from 1970-01 so that it is the same for all series.
    One row per series: ``slope``, ``intercept`` and the number of rows used.
    """
    rows = df if train_end is None else df.filter(F.col("ds") <= train_end)
    x = trend_position(F.col("ds"), grain)
    return rows.groupBy(*keys).agg(
        F.regr_slope("y", x).alias("slope"),
        F.regr_intercept("y", x).alias("intercept"),
        F.count("y").alias("n"),
    )


def trend_position(date: Column, grain: str) -> Column:
    epoch = F.lit("1970-01-05" if grain == "week" else "1970-01-01").cast("date")
    return periods_between(epoch, date, grain).cast("double")


def baseline_forecasts(panel: DataFrame, keys, horizon: int, grain: str, season: int, width: int,
                       origins=None, models=BASELINES) -> DataFrame:
    """Forecasts of all baselines from every origin, or from those where ``origins`` holds.

    Everything is read in windows over the series, so all models, origins and
    horizons cost one shuffle. ``origins`` is a condition on the column
    ``origin``. Rows carry the actual ``y``, null beyond the panel.
    """
    order = series_window(keys)
    past = order.rowsBetween(W.unboundedPreceding, -1)
    x = trend_position(F.col("ds"), grain)
    start = panel.select(
        *keys, "ds", F.col("y"),
        shift(F.col("ds"), -1, grain).alias("origin"),
        *([rolling_column(keys, "y", width, "mean").alias("_mean")] if "moving_average" in models else []),
        *([F.regr_slope("y", x).over(past).alias("_slope"), F.regr_intercept("y", x).over(past).alias("_intercept")]
          if "linear_trend" in models else []),
    )
    steps = []
    for h in range(1, horizon + 1):
        values = {
            "seasonal_naive": lambda h=h: F.lag("y", season - (h - 1) % season).over(order),
            "moving_average": lambda: F.col("_mean"),
            "linear_trend": lambda h=h: F.col("_intercept") + F.col("_slope") * (x + F.lit(h - 1.0)),
        }
        steps.append(F.struct(
            F.lit(h).alias("horizon"),
            F.lead("y", h - 1).over(order).alias("y"),
            F.array(*[F.struct(F.lit(m).alias("model"), values[m]().alias("yhat")) for m in models]).alias("f"),
        ))
    ahead = start.select(*keys, "origin", F.array(*steps).alias("_steps"))
    if origins is not None:
        ahead = ahead.filter(origins)
    by_step = ahead.select(*keys, "origin", F.explode("_steps").alias("_s"))
    return by_step.select(*keys, "origin", "_s.horizon", "_s.y", F.explode("_s.f").alias("_f")).select(
        *keys, "origin", shift(F.col("origin"), F.col("horizon"), grain).alias("ds"), "horizon",
        "_f.model", "y", "_f.yhat",
    )
