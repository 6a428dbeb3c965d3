"""Forecasts that add up, and what to compare them with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import exact_sum
from ..functions.periods import period_range, shift
from .joins import attach


def bottom_up(forecasts: DataFrame, parent: str = "region_key", child: str = "nation_key",
              run=("model", "origin", "horizon", "ds")) -> DataFrame:
    """Child forecasts and their sums per parent and in total.

    Forecasts are fixed to four decimals before they are added, so that sums are exact and agree with the
    children whatever the order of the rows.
    """
    run = list(run)
    return (
        forecasts.groupingSets([run, [*run, parent], [*run, parent, child]], *run, parent, child)
        .agg(F.grouping_id().alias("_level"), exact_sum("yhat").cast("double").alias("yhat"))
        .select(
            F.when(F.col("_level") == 0, child).when(F.col("_level") == 1, parent).otherwise("total").alias("level"),
            parent, child, *run, "yhat",
        )
    )


def top_down(parents: DataFrame, train: DataFrame, parent: str = "region_key", child: str = "nation_key") -> DataFrame:
    """Split each parent forecast by the children's share of training revenue.

    Children of a parent without any training revenue share it equally. A parent
    without training rows keeps its forecast whole, under a null child.
    """
    children = train.groupBy(parent, child).agg(exact_sum("y").alias("_y"))
    whole = children.groupBy(parent).agg(F.sum("_y").alias("_all"), F.count("*").alias("_n"))
    shares = attach(children, whole, [parent]).select(
        parent, child,
        F.coalesce(
            F.try_divide(F.col("_y").cast("double"), F.col("_all").cast("double")),
            F.lit(1.0) / F.col("_n"),
        ).alias("share"),
    )
    kept = [c for c in parents.columns if c not in ("yhat", child)]
    split = attach(parents.select(*kept, "yhat"), shares, [parent], "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    return split.select(*kept, child, "share", (F.col("yhat") * F.col("share")).alias("yhat"))


def future_frame(panel: DataFrame, keys, horizon: int, grain: str, last: Column | None = None) -> DataFrame:
    """The ``horizon`` periods after each series' last date, or after ``last`` for all."""
    ends = panel.groupBy(*keys).agg(F.max("ds").alias("_last"))
    end = F.col("_last") if last is None else last
    return ends.select(
        *keys, F.explode(period_range(shift(end, 1, grain), shift(end, horizon, grain), grain)).alias("ds"))


def actual_vs_forecast(actual: DataFrame, forecasts: DataFrame, keys) -> DataFrame:
    """Variance of each series and period, also where only one side has a row.

    ``status`` tells what there is, ``outside`` whether the actual value left the
    interval (null where that cannot be told).
    """
    keys = [*keys, "ds"]
    left = actual.select(*keys, "y", F.lit(True).alias("_actual"))
    right = forecasts.select(*keys, "yhat", "lo", "hi", F.lit(True).alias("_forecast"))
    return attach(left, right, keys, "full").select(
        *keys,
        "y", "yhat", "lo", "hi",
        (F.col("y") - F.col("yhat")).alias("variance"),
        F.try_divide(F.col("y") - F.col("yhat"), F.col("yhat")).alias("variance_rate"),
        F.when(F.col("_forecast").isNull(), "actual only")
        .when(F.col("_actual").isNull(), "forecast only").otherwise("both").alias("status"),
        (~F.col("y").between(F.col("lo"), F.col("hi"))).alias("outside"),
    )
