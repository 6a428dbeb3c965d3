"""Forecasts several periods ahead with the boosted model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import SEASONS, shift
from ..operators.features import FeatureSpec, drop_warmup, horizon_labels, series_window
from ..operators.reconcile import future_frame
from ..operators.splits import last_period
from ..session import materialize, side_by_side
from .gbt import GbtParams, Inputs, fit_gbt, past_or_model, predict_or_past, score_batch
from .trees import TreeTable


def direct_inputs(spec: FeatureSpec, keys, categories=None) -> Inputs:
    """Inputs of the direct model; ``categories`` are columns it may split on, by default none."""
    return Inputs((*spec.names, "horizon"), tuple(categories or ()), "label", (*keys, "origin", "horizon"))


def step_inputs(spec: FeatureSpec, keys, categories=None) -> Inputs:
    """Inputs of the one-step model; ``categories`` are columns it may split on, by default none."""
    return Inputs(tuple(spec.names), tuple(categories or ()), spec.column, (*keys, "ds"))


def horizon_table(panel: DataFrame, keys, horizons: int, grain: str, spec: FeatureSpec,
                  last: Column | None = None, season: int | None = None) -> DataFrame:
    """Training and scoring rows of all origins and horizons.

    One empty period is put after the panel, so that the last origin has its
    feature row too. Rows to score are those without a label. No row is left out:
    a series with too short a past has nulls in its features, ``seasonal`` holds its
    latest value whole seasons before the row's date, and ``past_mean`` the mean of
    what it has up to the origin.
    """
    last = last_period(panel) if last is None else last
    season = SEASONS[grain] if season is None else season
    ahead = future_frame(panel, keys, 1, grain, last)
    longer = panel.select(*keys, "ds", spec.column).unionByName(
        ahead.withColumn(spec.column, F.lit(None).cast("double")))
    order = series_window(keys)
    back = [F.lag(spec.column, season - h).over(order).cast("double") for h in range(min(horizons, season))]
    dated = (spec.from_panel(longer, keys)
             .withColumn("past_mean", F.avg(spec.column).over(order.rowsBetween(W.unboundedPreceding, -1)))
             .withColumn("_seasons", F.array(*back)))
    rows = horizon_labels(dated, keys, horizons, grain, spec.column)
    return rows.withColumn("seasonal", F.get("_seasons", (F.col("horizon") - 1) % season)).drop("_seasons")


def _trainable(spec: FeatureSpec, origin: Column) -> Column:
    """Rows of a ``horizon_table`` that a model for ``origin`` may learn from."""
    known = (F.col("ds") <= origin) & F.col("label").isNotNull()
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spec.past], known)


def training_counts(table: DataFrame, spec: FeatureSpec, origins: dict[int, Column]) -> dict[int, int]:
    """Number of rows a model could be fitted on for each fold's origin, in one job for all folds."""
    if not origins:
        return {}
    found = table.agg(*[F.count(F.when(_trainable(spec, o), 1)).alias(f"fold_{f}") for f, o in origins.items()]).first()
    return {fold: found[f"fold_{fold}"] for fold in origins}


def fit_direct(table: DataFrame, keys, spec: FeatureSpec, origin: Column, params: GbtParams = GbtParams(),
               categories=None) -> PipelineModel:
    """One model for all horizons, from rows whose label is dated up to ``origin``.

    ``table`` is a (stored) ``horizon_table``; the horizon is a feature.
    """
    return fit_gbt(table.filter(_trainable(spec, origin)), direct_inputs(spec, keys, categories), params)


def forecast_direct(table: DataFrame, keys, spec: FeatureSpec, origin: Column, params: GbtParams = GbtParams(),
                    categories=None) -> tuple[DataFrame, PipelineModel | None]:
    """Forecast all horizons from ``origin`` with one model fitted up to it.

    Where no row could be learnt from there is no model, and every series is forecast by its own past.
    """
    some = training_counts(table, spec, {0: origin})[0]
    model = fit_direct(table, keys, spec, origin, params, categories) if some else None
    return score_batch(model, table.filter(F.col("origin") == origin), keys, spec.past, "gbt_direct"), model


def backtest_direct(table: DataFrame, keys, spec: FeatureSpec, folds: dict[int, Column],
                    params: GbtParams = GbtParams(), categories=None, parallelism: int = 3) -> DataFrame:
    """Direct forecasts from each fold's origin, with the actual values as ``y``.

    A fold is a date filter on ``table``. Training rows are counted first, for all folds in one job: a fold
    without any has no model, and its series are forecast by their own past. The others are fitted side by
    side. ``past_mean`` is the level of the series at the origin.
    """
    counts = training_counts(table, spec, folds)

    def scored(fold: int) -> DataFrame:
        model = fit_direct(table, keys, spec, folds[fold], params, categories) if counts[fold] else None
        rows = predict_or_past(model, table.filter(F.col("origin") == folds[fold]), spec.past)
        return rows.select(
            *keys, F.lit(fold).alias("fold"), "origin", "ds", "horizon", F.lit("gbt_direct").alias("model"),
            F.col("label").alias("y"), "yhat", "status", "past_mean",
        )

    return reduce(DataFrame.unionByName, side_by_side(table.sparkSession, scored, folds, parallelism))


def fit_step(panel: DataFrame, keys, spec: FeatureSpec, params: GbtParams = GbtParams(),
             categories=None) -> PipelineModel | None:
    """One-step model for recursive forecasts; None if no row has the past that its features read."""
    rows = materialize(drop_warmup(spec.from_panel(panel, keys), [*spec.names, spec.column]))
    return None if rows.isEmpty() else fit_gbt(rows, step_inputs(spec, keys, categories), params)


def forecast_recursive(model: PipelineModel | None, panel: DataFrame, keys, horizons: int, grain: str, spec: FeatureSpec,
                       origin: Column | None = None, season: int | None = None) -> DataFrame:
    """Forecast step by step, reading earlier forecasts as if they had happened.

    Each series is one row with its last values, as many as the features read. All steps are one expression
    on it, in which the trees of the model are walked and every forecast is put after the values: any horizon
    is one job with one shuffle, and its plan does not grow with the horizon. Every series of ``panel`` gets
    all its horizons: one with too short a past, or without a model, its value one season before, else the mean
    of what it has up to ``origin``, else a null; ``status`` tells.
    """
    keys = list(keys)
    origin = last_period(panel) if origin is None else origin
    season = SEASONS[grain] if season is None else season
    ds, value = F.col("ds"), F.col(spec.column)
    recent = (ds <= origin) & (ds > shift(origin, -max(spec.depth, season), grain)) & value.isNotNull()
    state = panel.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(recent, F.struct("ds", value.cast("double").alias("y"))))).alias("_past"),
        F.avg(F.when(ds <= origin, value)).alias("past_mean"),
    ).withColumn("origin", origin)
    first = shift(F.col("origin"), -spec.depth, grain)
    history = F.transform(F.filter("_past", lambda p: p["ds"] > first), lambda p: p["y"])
    state = state.withColumn("_history", history)
    steps = F.sequence(F.lit(1), F.lit(horizons))
    forecast = F.transform(steps, lambda _: F.lit(None).cast("double"))
    if model is not None:
        trees, names = TreeTable.of(model), model.stages[-2].getInputCols()
        for stage in model.stages[:-2]:  # the index of the categories
            state = stage.transform(state)

        def step(values: Column, h: Column) -> Column:
            fields = spec.from_history(values, shift(F.col("origin"), h, grain))
            inputs = F.array(*[(fields[n] if n in fields else F.col(n)).cast("double") for n in names])
            return F.concat(values, F.array(trees.predict(inputs)))
        walked = F.slice(F.aggregate(steps, F.col("_history"), step), spec.depth + 1, horizons)
        forecast = F.when(F.size("_history") == spec.depth, walked).otherwise(forecast)
    ahead = state.select(*keys, "origin", "past_mean", "_past", F.posexplode(forecast).alias("_i", "_model"))
    ahead = ahead.withColumn("horizon", F.col("_i") + 1).withColumn("ds", shift(F.col("origin"), F.col("horizon"), grain))
    before = shift(F.col("ds"), -season * F.ceil(F.col("horizon") / season), grain)
    seasonal = F.get(F.filter("_past", lambda p: p["ds"] == before), 0)["y"]
    yhat, status = past_or_model(F.col("_model"), seasonal, F.col("past_mean"))
    return ahead.select(
        *keys, "origin", "ds", "horizon", F.lit("gbt_recursive").alias("model"), yhat,
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), status,
    )
