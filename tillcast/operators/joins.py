"""Joins on keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Columns of ``left`` and the other columns of ``right`` where ``keys`` match.

    Null keys meet each other, and ``right`` may be derived from ``left``. In a
    full join the keys are taken from the side that has them.
    """
    keys = list(keys)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined.select(
        *[F.coalesce(k, f"_r_{k}").alias(k) if how == "full" and k in keys else F.col(k) for k in left.columns],
        *[c for c in right.columns if c not in keys],
    )
