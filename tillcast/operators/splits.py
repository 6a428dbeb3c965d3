"""Splits that respect time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import periods_between, shift


def last_period(df: DataFrame, date: str = "ds") -> Column:
    return df.agg(F.max(date).alias("last")).scalar()


def holdout(df: DataFrame, horizon: int, grain: str, last: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows and the last ``horizon`` periods as test rows."""
    cut = shift(last_period(df) if last is None else last, -horizon, grain)
    return df.filter(F.col("ds") <= cut), df.filter(F.col("ds") > cut)


def fold_origin(last: Column, fold: int, n: int, horizon: int, step: int, gap: int, grain: str) -> Column:
    """Last training period of fold ``fold`` of ``n``; the last fold ends at ``last``."""
    return shift(last, -(horizon + gap + (n - fold) * step), grain)


def rolling_origin(df: DataFrame, n: int, horizon: int, step: int = 1, gap: int = 0,
                   grain: str = "month", last: Column | None = None) -> DataFrame:
    """Expanding-window folds: each row once per fold it takes part in.

    Fold ``f`` trains on rows up to its origin and tests on the ``horizon``
    periods after it and after ``gap`` periods left out. The folds are an array
    in the row's own expression, so no table of folds is joined.
    """
    last = last_period(df) if last is None else last
    back = periods_between(F.col("ds"), last, grain)
    marks = []
    for fold in range(1, n + 1):
        behind = horizon + gap + (n - fold) * step
        role = (
            F.when(F.col("_back") >= behind, "train")
            .when((F.col("_back") < behind - gap) & (F.col("_back") >= behind - gap - horizon), "test")
        )
        marks.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    tagged = df.withColumn("_back", back).select(
        *df.columns, F.explode(F.filter(F.array(*marks), lambda m: m["role"].isNotNull())).alias("_mark"))
    return tagged.select(*df.columns, "_mark.fold", "_mark.role")


def fold_rows(df: DataFrame, origin: Column, horizon: int, gap: int, grain: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a single fold, as plain date filters."""
    ds = F.col("ds")
    return (
        df.filter(ds <= origin),
        df.filter((ds > shift(origin, gap, grain)) & (ds <= shift(origin, gap + horizon, grain))),
    )
