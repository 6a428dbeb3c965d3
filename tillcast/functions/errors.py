"""Forecast error measures as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("mae", "rmse", "wape", "mape", "smape", "bias")


def error_columns(actual: str = "y", forecast: str = "yhat") -> list[Column]:
    """Count and error measures over rows that have both values.

    The relative measures are null where their base is zero: WAPE over groups
    without any actual value, MAPE over rows with a zero actual, sMAPE over rows
    where both values are zero.
    """
    y, yhat = F.col(actual), F.col(forecast)
    miss = F.abs(yhat - y)
    return [
        F.count(miss).alias("n"),
        F.avg(miss).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.try_divide(F.sum(miss), F.sum(F.when(miss.isNotNull(), F.abs(y)))).alias("wape"),
        F.avg(F.try_divide(miss, F.abs(y))).alias("mape"),
        F.avg(F.try_divide(2.0 * miss, F.abs(y) + F.abs(yhat))).alias("smape"),
        F.avg(yhat - y).alias("bias"),
    ]
