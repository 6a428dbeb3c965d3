"""Accuracy of forecasts, from rows that carry the actual ``y`` and ``yhat``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import error_columns
from .features import series_window
from .joins import attach


def metrics(df: DataFrame, by=()) -> DataFrame:
    """Count, MAE, RMSE, WAPE, MAPE, sMAPE and bias per group."""
    return df.groupBy(*by).agg(*error_columns())


def mase(df: DataFrame, train: DataFrame, keys, season: int, by=()) -> DataFrame:
    """MAE of each series over the in-sample MAE of its seasonal naive.

    The scale reads training rows only and is null for a series shorter than a
    season or without change; so is the result.
    """
    keys, extra = list(keys), list(by)
    naive = train.select(*keys, F.abs(F.col("y") - F.lag("y", season).over(series_window(keys))).alias("_miss"))
    scale = naive.groupBy(*keys).agg(F.avg("_miss").alias("scale"))
    mae = df.groupBy(*keys, *extra).agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae"))
    return attach(mae, scale, keys, "left").withColumn("mase", F.try_divide("mae", "scale"))


def metrics_cube(df: DataFrame, dims, always=("model",)) -> DataFrame:
    """The measures for each of ``dims``, for all of them together and in total.

    ``always`` stays in every group. Columns outside a row's group are null and
    ``grouped_by`` names the group, so real nulls are not mistaken for totals.
    """
    dims, always = list(dims), list(always)
    columns = [*always, *dims]
    sets = [always, *[[*always, d] for d in dims]]
    if len(dims) > 1:
        sets.append(columns)
    named = F.array_join(F.array_compact(F.array(*[F.when(F.grouping(d) == 0, d) for d in dims])), ",")
    return (
        df.groupingSets(sets, *columns)
        .agg(named.alias("grouped_by"), *error_columns())
    )


def leaderboard(scores: DataFrame, keys, metric: str = "wape") -> DataFrame:
    """Best model of each series; ties go to the first name, missing scores last."""
    best = F.min(F.struct(F.col(metric).isNull().alias("_none"), F.col(metric), F.col("model")))
    return scores.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best.model").alias("model"), F.col(f"_best.{metric}").alias(metric))


def worst_series(scores: DataFrame, keys, n: int, metric: str = "mae") -> DataFrame:
    """The ``n`` series with the largest error."""
    return scores.orderBy(F.col(metric).desc_nulls_last(), *[F.col(k) for k in keys]).limit(n)


def residual_acf(df: DataFrame, keys, ks, by=()) -> DataFrame:
    """Correlation of each series' residuals with those ``k`` dates earlier.

    Name in ``by`` what else tells the rows of a date apart, such as model and
    fold: they are correlated apart. Rows that still share a date count as their
    mean, so no order of rows can matter.
    """
    keys = [*keys, *by]
    order = series_window(keys)
    error = F.avg(F.col("y") - F.col("yhat"))
    with_error = df.repartition(*[F.col(k) for k in keys]).groupBy(*keys, "ds").agg(error.alias("_e"))
    lagged = with_error.select(*keys, "_e", *[F.lag("_e", k).over(order).alias(f"_e_{k}") for k in ks])
    return lagged.groupBy(*keys).agg(*[F.corr("_e", f"_e_{k}").alias(f"acf_{k}") for k in ks])
