"""The forecasting job: forecasts with intervals that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.gbt import GbtParams
from ..models.horizons import backtest_direct, horizon_table
from ..operators.features import FeatureSpec
from ..operators.intervals import residual_interval, with_interval
from ..session import materialize
from .backtest import fold_origins


def forecast_revenue(panel: DataFrame, keys, grain: str, horizon: int = 12, folds: int = 2,
                     spec: FeatureSpec = FeatureSpec(), params: GbtParams = GbtParams(),
                     lo: float = 0.1, hi: float = 0.9, last: Column | None = None, categories=None) -> DataFrame:
    """Rows of the ``forecasts`` table for the ``horizon`` periods after the panel.

    The limits come from backtest residuals, pooled over series per horizon: a
    single series has too few folds for quantiles of its own. They are pooled
    relative to the mean of the series' past and multiplied with it again, so that
    small and large series get limits of their own size; ``lo`` does not fall below
    zero, and a series without a positive past mean has no limits. Any history will do: where no row
    could be learnt from, as in a panel shorter than the features read and one horizon, series
    are forecast by their own past, which ``status`` tells; an empty panel gives no rows. The final model
    and those of the folds read the same stored table and are fitted side by side;
    fold 0 is the final one, which has no actual values yet.
    """
    table = materialize(horizon_table(panel, keys, horizon, grain, spec, last))
    origins = fold_origins(table, folds, horizon, horizon, grain)
    final = F.lit(table.agg(F.max("origin").alias("last")).first()["last"]).cast("date")
    rows = materialize(backtest_direct(table, keys, spec, {0: final, **origins}, params, categories))
    level = F.when(F.col("past_mean") > 0, F.col("past_mean"))
    known = rows.filter((F.col("fold") > 0) & level.isNotNull())
    relative = known.select("horizon", (F.col("y") / level).alias("y"), (F.col("yhat") / level).alias("yhat"))
    limits = residual_interval(relative, ["horizon"], lo, hi, pooled=True)
    final_rows = rows.filter(F.col("fold") == 0).drop("fold", "y")
    return with_interval(final_rows, limits, ["horizon"], level, F.lit(0.0)).drop("past_mean")
