"""Training and use of the global gradient-boosted model."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import error_columns
from ..operators.features import fit_key_index
from ..operators.running import running_totals
from ..session import side_by_side


@dataclass(frozen=True)
class GbtParams:
    """Settings of a fit. ``pieces`` is the least number of tasks that the training rows are laid out in: up to
    ``pieces * PIECE_ROWS`` rows it is the number, and more rows get more pieces, so that no task of a fit
    holds more than about ``PIECE_ROWS`` of them. Split
    candidates are the trainer's own: at most ``bins`` values of an input, from a sample of
    max(bins ** 2, 10,000) rows."""

    trees: int = 20
    depth: int = 4
    step: float = 0.1
    bins: int = 32
    loss: str = "squared"
    seed: int = 42
    subsample: float = 1.0
    min_rows: int = 1
    pieces: int = 8


@dataclass(frozen=True)
class Inputs:
    """What a model reads: numbers, categories, the label, and the columns that
    tell the training rows apart (they fix the order of the rows). Trees hold the
    labels of a category, so name only columns with few values; a series comes in
    through its own past, which looks the same for any number of series.

    Rows that miss a number cannot be learnt from, except for numbers named in
    ``imputed``: a gap in one is filled with its mean over the training rows, and
    an input of its own, 1 or 0, says that it was a gap."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    label: str = "y"
    identity: tuple[str, ...] = ("ds",)
    imputed: tuple[str, ...] = ()

    @property
    def assembled(self) -> list[str]:
        numbers = [name for c in self.numeric for name in ((f"{c}_filled", f"{c}_missing") if c in self.imputed else (c,))]
        return [f"{c}_index" for c in self.categorical] + numbers


# Training rows that one task of a fit holds at most, once there are more than ``GbtParams.pieces`` times as many.
PIECE_ROWS = 1_000_000


def layout_pieces(rows: DataFrame, least: int) -> int:
    """Pieces for ``rows``: ``least``, or as many as hold ``PIECE_ROWS`` each if that is more. The same rows
    always get the same number, so a fit stays the same for the same rows."""
    return max(least, -(-rows.count() // PIECE_ROWS))


def fixed_layout(df: DataFrame, identity, tasks: int) -> DataFrame:
    """Place and order rows by their own values only.

    Split statistics are sums of floating point numbers, and near-tied splits
    flip with the order of summation. Hashing the identity to a fixed number of
    partitions and sorting inside them gives the same sums for the same rows,
    however they were read, and spreads a large series evenly.
    """
    return df.repartition(tasks, *identity).sortWithinPartitions(*identity)


@dataclass
class TrainingRows:
    """Rows that are laid out for fits, held by the executors until ``release``, and the stages that made them."""

    rows: DataFrame
    stages: list
    categories: int
    with_validation: bool

    def release(self) -> None:
        self.rows.unpersist()


def gap_stages(train: DataFrame, columns) -> list:
    """Stages that mark the gaps of number columns and fill them with the means of ``train``.

    They add ``<column>_missing`` and ``<column>_filled``, and are stored with a model. A column that has
    gaps only is filled with zeros.
    """
    columns = list(columns)
    value = {c: F.col(c).cast("double") for c in columns}
    known = train.agg(*[F.avg(F.when(~F.isnan(v), v)).alias(c) for c, v in value.items()]).first()
    marks = ", ".join(f"IF(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)), 1.0D, 0.0D) AS `{c}_missing`" for c in columns)
    fills = ", ".join(f"IF(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)), {known[c] or 0.0!r}D, CAST(`{c}` AS DOUBLE)) AS `{c}_filled`"
                      for c in columns)
    return [SQLTransformer(statement=f"SELECT *, {marks}, {fills} FROM __THIS__")]


def lay_out(train: DataFrame, inputs: Inputs, valid: DataFrame | None = None, tasks: int = 8) -> TrainingRows:
    """Index, assemble and place training rows once, for any number of fits, in at least ``tasks`` pieces."""
    rows = train.withColumn("_valid", F.lit(False))
    if valid is not None:
        rows = rows.unionByName(valid.withColumn("_valid", F.lit(True)))
    rows = rows.select(
        *inputs.identity, *[c for c in (*inputs.categorical, *inputs.numeric) if c not in inputs.identity],
        F.col(inputs.label).cast("double").alias("_label"), "_valid",
    )
    stages, categories = [], 0
    if inputs.categorical:
        index = fit_key_index(train, inputs.categorical)
        categories = max(len(labels) for labels in index.labelsArray)
        stages.append(index)
    if inputs.imputed:
        stages += gap_stages(train, inputs.imputed)
    stages.append(VectorAssembler(inputCols=inputs.assembled, outputCol="features"))
    assembled = rows
    for stage in stages:
        assembled = stage.transform(assembled)
    tasks = layout_pieces(rows, tasks)
    laid_out = fixed_layout(assembled.select(*inputs.identity, "features", "_label", "_valid"), inputs.identity, tasks)
    laid_out = laid_out.select("features", "_label", "_valid").persist(StorageLevel.MEMORY_AND_DISK)
    return TrainingRows(laid_out, stages, categories, valid is not None)


def fit_rows(laid_out: TrainingRows, params: GbtParams) -> PipelineModel:
    """Fit one model on rows that are laid out. Without training rows there is nothing to fit: a ValueError."""
    trainer = GBTRegressor(
        featuresCol="features", labelCol="_label", predictionCol="yhat", maxIter=params.trees, maxDepth=params.depth,
        stepSize=params.step, maxBins=max(params.bins, laid_out.categories + 1), lossType=params.loss, seed=params.seed,
        subsamplingRate=params.subsample, minInstancesPerNode=params.min_rows,
    )
    if laid_out.with_validation:
        trainer = trainer.setValidationIndicatorCol("_valid")
    try:
        model = trainer.fit(laid_out.rows)
    except IllegalArgumentException as error:
        if "input RDD" not in str(error):
            raise
        raise ValueError("there are no training rows") from error
    return PipelineModel(stages=[*laid_out.stages, model])


def fit_gbt(train: DataFrame, inputs: Inputs, params: GbtParams = GbtParams(), valid: DataFrame | None = None,
            tasks: int | None = None) -> PipelineModel:
    """Fit one boosted-tree model over all series.

    The result is a pipeline that indexes, assembles and predicts ``yhat``. The
    rows are read several times, so they should be a stored table. With ``valid`` training stops when another tree no longer helps on those rows.
    Categories unseen in training are scored with the index's spare value. Without training rows there is
    nothing to fit: a ValueError.
    """
    laid_out = lay_out(train, inputs, valid, tasks or params.pieces)
    try:
        return fit_rows(laid_out, params)
    finally:
        laid_out.release()


def early_stop(train: DataFrame, valid: DataFrame, inputs: Inputs, params: GbtParams = GbtParams()) -> PipelineModel:
    """Fit that stops adding trees once a later-in-time slice no longer gains."""
    return fit_gbt(train, inputs, params, valid=valid)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``yhat``, without the model's helper columns."""
    return model.transform(df).select(*df.columns, "yhat")


def predict_or_past(model: PipelineModel | None, df: DataFrame, past) -> DataFrame:
    """``df`` with ``yhat`` and ``status``, for all of its rows.

    The model is used where there is one and the row has all ``past`` features. Other rows get the value of
    their series one season before, in ``seasonal``, or else the mean of what it has, in ``past_mean``.
    ``status`` is model, seasonal value, mean of past, or no past (then ``yhat`` is null).
    """
    if model is None:
        rated = df.withColumn("_model", F.lit(None).cast("double"))
    else:
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in past], F.lit(True))
        flagged = df.withColumn("_complete", complete).fillna(0.0, subset=list(past))
        rated = predict(model, flagged).withColumn("_model", F.when(F.col("_complete"), F.col("yhat")))
    return rated.select(*df.columns, *past_or_model(F.col("_model"), F.col("seasonal"), F.col("past_mean")))


def past_or_model(model: Column, seasonal: Column, mean: Column) -> tuple[Column, Column]:
    """``yhat``, the first of the three that is known, and its ``status``."""
    status = (F.when(model.isNotNull(), "model").when(seasonal.isNotNull(), "seasonal value")
              .when(mean.isNotNull(), "mean of past").otherwise("no past"))
    return F.coalesce(model, seasonal, mean).alias("yhat"), status.alias("status")


def score_batch(model: PipelineModel | None, frame: DataFrame, keys, past, name: str = "gbt") -> DataFrame:
    """Forecast rows, without limits, for feature rows with ``origin`` and ``horizon``."""
    return predict_or_past(model, frame, past).select(
        *keys, "origin", "ds", "horizon", F.lit(name).alias("model"), "yhat",
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "status",
    )


def tree_count(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def feature_importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Inputs of a model by importance; there is one row per input column."""
    names = model.stages[-2].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(names, values), key=lambda pair: (-pair[1], pair[0]))
    return spark.createDataFrame(
        [(n, v, i + 1) for i, (n, v) in enumerate(ranked)], "feature string, importance double, position int")


def log_target(column: str = "y") -> Column:
    """Target on a log scale, for revenue that varies by orders of magnitude."""
    return F.log1p(F.col(column))


def unlog(column: str = "yhat") -> Column:
    """Back to revenue; forecasts do not fall below zero."""
    return F.greatest(F.expm1(F.col(column)), F.lit(0.0))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def split_gain(df: DataFrame, feature: str, label: str = "y") -> DataFrame:
    """Share of label variance explained by each threshold of one feature.

    The largest share is the split a squared-error tree makes first. Rows are
    reduced to one per distinct value, then added up along the sorted values.
    """
    known = df.filter(F.col(feature).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("double")
    per_value = known.groupBy(F.col(feature).alias("threshold")).agg(
        F.count("*").alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_ss"))
    left = running_totals(per_value, ["threshold"], {
        "n_left": F.col("_n"), "sum_left": F.col("_s"), "squares": F.col("_ss")})
    n, total = F.col("n_left_total"), F.col("sum_left_total")
    n_right, sum_right = n - F.col("n_left"), total - F.col("sum_left")
    between = (
        F.col("sum_left") * F.col("sum_left") / F.col("n_left") + sum_right * sum_right / n_right - total * total / n
    )
    return left.filter(n_right > 0).select(
        "threshold", "n_left", n_right.alias("n_right"),
        F.try_divide(between, F.col("squares_total") - total * total / n).alias("gain_share"),
    )


def param_grid(base: GbtParams = GbtParams(), **choices) -> list[GbtParams]:
    """All combinations of the given values, for example ``depth=[3, 5]``."""
    names = list(choices)
    return [replace(base, **dict(zip(names, values))) for values in itertools.product(*choices.values())]


def _fold_scores(folds, inputs: Inputs, grid: dict[int, GbtParams], laid_out: dict, parallelism: int) -> DataFrame:
    """Errors of settings (by their number) on all folds: fits run side by side, one job scores them."""
    def fit(task):
        setting, fold = task
        return setting, fold, fit_rows(laid_out[fold, grid[setting].pieces], grid[setting])

    scored = []
    tasks = [(s, f) for s in grid for f in range(len(folds))]
    for setting, fold, model in side_by_side(folds[0][0].sparkSession, fit, tasks, parallelism):
        params = grid[setting]
        scored.append(predict(model, folds[fold][1]).select(
            F.lit(setting).alias("setting"), F.lit(fold + 1).alias("fold"),
            F.lit(params.trees).alias("trees"), F.lit(params.depth).alias("depth"),
            F.lit(params.step).alias("step"), F.col(inputs.label).alias("y"), "yhat",
        ))
    return reduce(DataFrame.unionByName, scored).groupBy("setting", "fold", "trees", "depth", "step").agg(*error_columns())


def tune_gbt(folds, inputs: Inputs, grid: list[GbtParams], parallelism: int = 2, first_trees: int | None = None,
             metric: str = "wape") -> DataFrame:
    """Score every setting on every time fold.

    ``folds`` are pairs of train and test rows (random folds would leak the
    future). The training rows of a fold are laid out once and serve all settings. Fits run ``parallelism``
    at a time; scoring is one job over all of them.

    With ``first_trees`` all settings are tried with so few trees first, and only the better half by the
    mean of ``metric`` (at least one, and settings with so few trees anyway) is fitted and scored in full.
    """
    folds, numbered = list(folds), dict(enumerate(grid))
    laid_out = {(f, pieces): lay_out(folds[f][0], inputs, tasks=pieces)
                for f in range(len(folds)) for pieces in dict.fromkeys(p.pieces for p in grid)}
    try:
        large = {s: p for s, p in numbered.items() if first_trees and p.trees > first_trees}
        if len(large) > 1:
            tried = {s: replace(p, trees=first_trees) for s, p in large.items()}
            means = _fold_scores(folds, inputs, tried, laid_out, parallelism).groupBy("setting").agg(F.avg(metric).alias("m"))
            order = [r.setting for r in means.filter("m is not null").orderBy("m", "setting").collect()]  # a row per setting
            for setting in set(large) - set(order[:(len(large) + 1) // 2]):
                del numbered[setting]
        return _fold_scores(folds, inputs, numbered, laid_out, parallelism)
    finally:
        for rows in laid_out.values():
            rows.release()


def best_setting(scores: DataFrame, metric: str = "wape") -> DataFrame:
    """The setting with the lowest mean score over its folds, as one row."""
    means = scores.groupBy("setting", "trees", "depth", "step").agg(F.avg(metric).alias(metric))
    best = F.min_by(F.struct("setting", "trees", "depth", "step", metric), F.struct(F.col(metric), F.col("setting")))
    return means.filter(F.col(metric).isNotNull()).agg(best.alias("_b")).select("_b.*")
