"""Exact running totals and quantiles over data too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .joins import attach


def running_totals(df: DataFrame, order_by, sums: dict[str, Column], partition_by=()) -> DataFrame:
    """Add the cumulative sum of each of ``sums`` in the given order, and its total.

    Entry ``n`` of ``sums`` gives the columns ``n`` and ``n_total``.

    A window without partitioning would send every row to one task, and one
    partitioned by a hot key a large share of them. Here the rows are sorted
    across the cluster and stored with the number of their piece, each piece is
    summed on its own, and the totals of the pieces before it are added. Only
    those totals, one row per piece and group, are accumulated in one place.
    ``order_by`` has to order the rows of a group without ties.
    """
    groups = list(partition_by)
    names = list(sums)
    added = df.select("*", *[sums[n].alias(f"_v_{n}") for n in names])
    pieces = materialize(added.orderBy(*groups, *order_by).withColumn("_piece", F.spark_partition_id()))

    whole = W.partitionBy(*groups)
    earlier = whole.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        pieces.groupBy(*groups, "_piece").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
        .select(
            *groups, "_piece",
            *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in names],
            *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in names],
        )
    )
    inside = W.partitionBy("_piece", *groups).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    summed = pieces.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in names])
    return attach(summed, carried, ["_piece", *groups]).select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in names],
        *[f"{n}_total" for n in names],
    )


def pooled_quantiles(df: DataFrame, value: str, probs: dict[str, float], by=()) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group of any size.

    The aggregate ``percentile`` keeps all values of a group in one task; this
    finds the two neighbouring ranks of each quantile through running counts.
    """
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    ranked = running_totals(counted, ["_x"], {"_upto": F.col("_n")}, by)
    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_x")))

    pieces = []
    for name, p in probs.items():
        position = (F.col("_upto_total") - 1) * F.lit(float(p))
        pieces += [
            value_at(F.floor(position)).alias(f"_lo_{name}"),
            value_at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
    found = ranked.groupBy(*by).agg(*pieces)
    return found.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in probs
    ])
