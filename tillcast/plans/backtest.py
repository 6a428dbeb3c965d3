"""Rolling-origin comparison of the boosted model with the baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import periods_between
from ..models.gbt import GbtParams, fit_gbt, predict
from ..models.horizons import backtest_direct, horizon_table, step_inputs
from ..operators.baselines import BASELINES, baseline_forecasts
from ..operators.evaluate import metrics
from ..operators.features import FeatureSpec, drop_warmup
from ..operators.splits import fold_origin, holdout, last_period
from ..session import materialize
from ..sources.sales import SalesTables
from .panels import dense_panel, period_bounds


def fold_of(origin: Column, last: Column, n: int, horizon: int, step: int, grain: str) -> Column:
    """Number of the fold with this origin, null for other origins."""
    behind = periods_between(origin, last, grain) - horizon
    fold = F.lit(n) - F.floor(behind / F.lit(step))
    return F.when((behind % step == 0) & fold.between(1, n), fold.cast("int"))


def backtest_baselines(panel: DataFrame, keys, grain: str, n: int, horizon: int, step: int, season: int, width: int,
                       last: Column | None = None, models=BASELINES) -> DataFrame:
    """Forecasts of the baselines from every fold's origin, in one pass."""
    last = last_period(panel) if last is None else last
    fold = fold_of(F.col("origin"), last, n, horizon, step, grain)
    rows = baseline_forecasts(panel, keys, horizon, grain, season, width, fold.isNotNull(), models)
    return rows.select(*keys, fold.alias("fold"), "origin", "ds", "horizon", "model", "y", "yhat")


def fold_origins(table: DataFrame, n: int, horizon: int, step: int, grain: str) -> dict[int, Column]:
    """Origins of the folds of a stored ``horizon_table``, as literal dates."""
    last = F.lit(table.agg(F.max("origin").alias("last")).first()["last"]).cast("date")
    return {fold: fold_origin(last, fold, n, horizon, step, 0, grain) for fold in range(1, n + 1)}


def backtest_gbt(panel: DataFrame, keys, grain: str, n: int, horizon: int, step: int, spec: FeatureSpec,
                 params: GbtParams = GbtParams(), last: Column | None = None, categories=None) -> DataFrame:
    """Forecasts of the boosted model, fitted anew for every fold.

    The table of all origins and horizons is built and stored once.
    """
    table = materialize(horizon_table(panel, keys, horizon, grain, spec, last))
    folds = fold_origins(table, n, horizon, step, grain)
    return backtest_direct(table, keys, spec, folds, params, categories).drop("past_mean")


def backtest(panel: DataFrame, keys, grain: str, n: int = 3, horizon: int = 12, step: int = 1, season: int = 12,
             width: int = 12, spec: FeatureSpec = FeatureSpec(), params: GbtParams = GbtParams(),
             last: Column | None = None, categories=None) -> DataFrame:
    """Actual and forecast of all models on all folds, one row each."""
    baselines = backtest_baselines(panel, keys, grain, n, horizon, step, season, width, last)
    baselines = baselines.withColumn("status", F.lit("baseline"))
    return baselines.unionByName(backtest_gbt(panel, keys, grain, n, horizon, step, spec, params, last, categories))


def next_value_comparison(tables: SalesTables, keys, grain: str = "month", horizon: int = 12,
                          spec: FeatureSpec = FeatureSpec(), params: GbtParams = GbtParams(trees=10),
                          categories=None) -> DataFrame:
    """Is the boosted model better than last year's value, one period ahead?"""
    bounds = period_bounds(tables, grain)
    panel = dense_panel(tables, keys, grain, bounds=bounds)
    rows = materialize(drop_warmup(spec.from_panel(panel, keys), spec.names))
    train, test = holdout(rows, horizon, grain, bounds[1])
    model = fit_gbt(train, step_inputs(spec, keys, categories), params)
    season = f"y_lag_{max(spec.lags)}"
    scored = predict(model, test).select("y", F.explode(F.array(
        F.struct(F.lit("gbt").alias("model"), F.col("yhat").alias("yhat")),
        F.struct(F.lit("seasonal_naive").alias("model"), F.col(season).alias("yhat")),
    )).alias("_f")).select("_f.model", "y", "_f.yhat")
    return metrics(scored, ["model"])
