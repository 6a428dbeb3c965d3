"""Features that read only what is known before the row's own period.

All window frames end before the current row of a dense panel: the row dated
one period after an origin holds what is known at that origin. They share one
partitioning and order, so Spark computes them after a single shuffle. A series
has at most one row per calendar period, which bounds every window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, fourier_columns
from ..functions.periods import shift
from .joins import attach

ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def series_window(keys):
    return W.partitionBy(*keys).orderBy("ds")


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[c.alias(n) for n, c in columns.items()])


def lags(df: DataFrame, keys, column: str, ks) -> DataFrame:
    """Values ``k`` periods back."""
    order = series_window(keys)
    return _add(df, {f"{column}_lag_{k}": F.lag(column, k).over(order) for k in ks})


def driver_lags(df: DataFrame, keys, columns, ks) -> DataFrame:
    """Lags of measures that are not known ahead, such as units or discount."""
    order = series_window(keys)
    return _add(df, {f"{c}_lag_{k}": F.lag(c, k).over(order) for c in columns for k in ks})


def rolling_column(keys, column: str, width: int, fn: str, min_periods: int | None = None) -> Column:
    frame = series_window(keys).rowsBetween(-width, -1)
    needed = width if min_periods is None else min_periods
    return F.when(F.count(column).over(frame) >= needed, ROLLING[fn](column).over(frame))


def rolling(df: DataFrame, keys, column: str, width: int, fns=("mean",), min_periods: int | None = None) -> DataFrame:
    """Trailing statistics of the ``width`` periods before each row.

    Null until ``min_periods`` of them (by default all) are there.
    """
    return _add(df, {f"{column}_{fn}_{width}": rolling_column(keys, column, width, fn, min_periods) for fn in fns})


def expanding(df: DataFrame, keys, column: str) -> DataFrame:
    """Mean of everything earlier in the series."""
    frame = series_window(keys).rowsBetween(W.unboundedPreceding, -1)
    return _add(df, {f"{column}_expanding": F.avg(column).over(frame)})


def ewma(df: DataFrame, keys, column: str, alpha: float, depth: int) -> DataFrame:
    """Exponential mean of the last ``depth`` periods, weights adding up to one."""
    order = series_window(keys)
    weights = [alpha * (1 - alpha) ** i for i in range(depth)]
    total = sum(weights)
    mean = F.lit(0.0)
    for i, weight in enumerate(weights):
        mean = mean + F.lag(column, i + 1).over(order) * F.lit(weight / total)
    return _add(df, {f"{column}_ewma": mean})


def growth(df: DataFrame, keys, column: str, k: int) -> DataFrame:
    """Change of the last known period relative to ``k`` periods before it."""
    order = series_window(keys)
    recent, base = F.lag(column, 1).over(order), F.lag(column, k + 1).over(order)
    return _add(df, {f"{column}_growth_{k}": F.try_divide(recent - base, base)})


def calendar(df: DataFrame, date: str = "ds") -> DataFrame:
    """Calendar fields of the row's own (target) date."""
    return _add(df, calendar_columns(F.col(date)))


def fourier(df: DataFrame, period: float, order: int, position: Column | None = None) -> DataFrame:
    """Seasonal waves; by default over the month of ``ds``."""
    return _add(df, fourier_columns(F.month("ds") if position is None else position, period, order))


def seasonal_index(df: DataFrame, keys, train_end: Column, column: str = "y") -> DataFrame:
    """Mean of the row's calendar month over the series mean, from training rows.

    A month or series without training revenue gets the neutral index 1.
    """
    known = F.when(F.col("ds") <= train_end, F.col(column))
    dated = df.withColumn("_month", F.month("ds"))
    by_month = F.avg(known).over(W.partitionBy(*keys, "_month"))
    overall = F.avg(known).over(W.partitionBy(*keys))
    return dated.withColumn(
        "seasonal_index", F.coalesce(F.try_divide(by_month, overall), F.lit(1.0))).drop("_month")


def target_encode_past(df: DataFrame, category, column: str = "y") -> DataFrame:
    """Mean of earlier target values of a category.

    The category is first reduced to one row per period. This keeps peers of the
    same period out of the mean, and keeps a category that holds many series from
    filling one task. Adds ``<category>_past_mean``.
    """
    category = [category] if isinstance(category, str) else list(category)
    before = W.partitionBy(*category).orderBy("ds").rowsBetween(W.unboundedPreceding, -1)
    per_period = df.groupBy(*category, "ds").agg(F.sum(column).alias("_sum"), F.count(column).alias("_count"))
    encoded = per_period.select(
        *category, "ds",
        F.try_divide(F.sum("_sum").over(before), F.sum("_count").over(before).cast("double"))
        .alias("_".join(category) + "_past_mean"),
    )
    return attach(df, encoded, [*category, "ds"], "left")


def fit_key_index(df: DataFrame, columns):
    """A category index for trees; null and unseen values get the spare last index.

    The trainer holds the labels of an index in the model, so name columns with
    few values; encode others with ``target_encode_past``.
    """
    columns = list(columns)
    return StringIndexer(
        inputCols=columns, outputCols=[f"{c}_index" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(df)


def index_keys(df: DataFrame, columns) -> DataFrame:
    """Add ``<column>_index``, the alphabetical position of each category."""
    return fit_key_index(df, columns).transform(df)


def horizon_labels(df: DataFrame, keys, horizons: int, grain: str, label: str = "y",
                   drop=("units", "n_orders", "avg_discount")) -> DataFrame:
    """One row per origin and horizon.

    The feature row dated one period after the origin gives the features, the
    row ``h`` periods after the origin gives ``label``, and calendar fields are
    recomputed for that date. Rows whose label lies beyond the panel keep a null
    label: they are the rows to score. Measures of the feature row itself are
    dropped, as they are not known at the origin. The label is read in the
    window the features use, so the rows are multiplied only after the shuffle.
    """
    order = series_window(keys)
    ahead = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lead(label, h - 1).over(order).alias("label"))
        for h in range(1, horizons + 1)
    ])
    spread = df.select("*", ahead.alias("_all")).select(*df.columns, F.explode("_all").alias("_ahead"))
    target = shift(F.col("ds"), F.col("_ahead.horizon") - 1, grain)
    fields = calendar_columns(target)
    gone = {*keys, "ds", label, *drop}
    kept = [c for c in df.columns if c not in gone and c not in fields]
    return spread.select(
        *keys,
        shift(F.col("ds"), -1, grain).alias("origin"),
        F.col("_ahead.horizon").alias("horizon"),
        target.alias("ds"),
        *kept,
        *[fields[c].alias(c) for c in df.columns if c in fields],
        F.col("_ahead.label").cast("double").alias("label"),
    )


def drop_warmup(df: DataFrame, columns) -> DataFrame:
    """Remove rows that miss any of the required features."""
    return df.dropna(subset=list(columns))


@dataclass(frozen=True)
class FeatureSpec:
    """A feature set that can be built from a panel or from a series' last values."""

    lags: tuple[int, ...] = (1, 2, 3, 12)
    means: tuple[int, ...] = (3, 12)
    calendar: tuple[str, ...] = ("month",)
    column: str = "y"

    @property
    def past(self) -> list[str]:
        return [f"{self.column}_lag_{k}" for k in self.lags] + [f"{self.column}_mean_{w}" for w in self.means]

    @property
    def names(self) -> list[str]:
        return [*self.past, *self.calendar]

    @property
    def depth(self) -> int:
        """How many past periods the features read."""
        return max((*self.lags, *self.means), default=0)

    def from_panel(self, panel: DataFrame, keys) -> DataFrame:
        order = series_window(keys)
        fields = calendar_columns(F.col("ds"))
        return _add(panel, {
            **{f"{self.column}_lag_{k}": F.lag(self.column, k).over(order) for k in self.lags},
            **{f"{self.column}_mean_{w}": rolling_column(keys, self.column, w, "mean") for w in self.means},
            **{c: fields[c] for c in self.calendar},
        })

    def from_history(self, values: Column, date: Column) -> dict[str, Column]:
        """The same features of ``date`` from an array of the values before it, oldest first."""
        fields = calendar_columns(date)

        def mean(width: int) -> Column:
            recent = F.slice(values, -width, width)
            return F.aggregate(recent, F.lit(0.0), lambda total, x: total + x) / F.lit(float(width))

        return {
            **{f"{self.column}_lag_{k}": F.get(values, F.size(values) - k) for k in self.lags},
            **{f"{self.column}_mean_{w}": mean(w) for w in self.means},
            **{c: fields[c] for c in self.calendar},
        }
