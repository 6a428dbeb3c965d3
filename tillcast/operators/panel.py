"""Dense revenue panels: one row per series and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import exact_sum, from_units, money, with_revenue
from ..functions.periods import period_range, period_start, shift
from ..sources.sales import CUSTOMER_COLUMNS, LINE_COLUMNS, SalesTables, order_amounts, order_side
from .running import running_totals

MEASURES = ("y", "units", "n_orders", "avg_discount")

# Syntetos-Boylan cut-offs for demand classes (fixed values).
ADI_CUT = 1.32
CV2_CUT = 0.49


def _panel_columns(revenue: Column, units: Column, orders: Column, discounts: Column, lines: Column) -> list[Column]:
    return [
        revenue.cast("double").alias("y"),
        units.cast("double").alias("units"),
        orders.alias("n_orders"),
        F.try_divide(discounts.cast("double"), lines.cast("double")).alias("avg_discount"),
    ]


def revenue_by_period(sales: DataFrame, keys, grain: str) -> DataFrame:
    """Revenue, units, orders and mean discount per series and period."""
    return (
        with_revenue(sales)
        .withColumn("ds", period_start(F.col("ds"), grain))
        .groupBy(*keys, "ds")
        .agg(*_panel_columns(
            F.sum("revenue"), F.sum(money("qty")), F.count_distinct("order_key"),
            F.sum("discount"), F.count("discount"),
        ))
    )


def revenue_panel(tables: SalesTables, keys, grain: str, exclude_returns: bool = False,
                  bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """``revenue_by_period`` straight from the source tables.

    Lines are added up per order before they meet the orders. That shrinks the
    join, keeps an order that holds a large share of the lines down to one row
    per task, and leaves one row per order and series, so orders are counted
    without a distinct. ``bounds`` keeps only the periods between the two.
    """
    on_lines = [k for k in keys if k in LINE_COLUMNS]
    on_orders = [k for k in keys if k not in LINE_COLUMNS]
    unknown = set(on_orders) - {*CUSTOMER_COLUMNS, "customer_key"}
    if unknown:
        raise ValueError(f"unknown series keys: {sorted(unknown)}")
    since, until = (bounds[0], shift(bounds[1], 1, grain)) if bounds else (None, None)
    orders = order_side(tables, on_orders, since, until).withColumn("ds", period_start(F.col("ds"), grain))
    return (
        order_amounts(tables, on_lines, exclude_returns)
        .join(orders, "order_key")
        .groupBy(*keys, "ds")
        .agg(*_panel_columns(
            from_units(F.sum("net"), 4), from_units(F.sum("units"), 2), F.count("*"),
            from_units(F.sum("discounts"), 2), F.sum("lines"),
        ))
    )


def densify(panel: DataFrame, keys, grain: str, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Fill every series to the full calendar; missing periods get zeros.

    Each row is stretched over the gap up to the next row of its series (and the
    first also back to the start), so no calendar is joined: the only shuffle is
    by ``keys``, which the feature windows then reuse. Rows outside ``bounds`` are
    left out, on either side. Without ``bounds`` the range is taken from the panel
    itself, which runs its plan a second time.
    """
    keys = list(keys)
    if bounds is None:
        bounds = (panel.agg(F.min("ds").alias("ds")).scalar(), panel.agg(F.max("ds").alias("ds")).scalar())
    else:
        panel = panel.filter(F.col("ds").between(*bounds))
    start, end = bounds
    measures = [c for c in panel.columns if c not in (*keys, "ds")]
    order = W.partitionBy(*keys).orderBy("ds")
    stretched = panel.select(
        "*",
        F.when(F.lag("ds").over(order).isNull(), start).otherwise(F.col("ds")).alias("_from"),
        F.coalesce(shift(F.lead("ds").over(order), -1, grain), end).alias("_to"),
    )
    filled = stretched.select(
        "*", F.explode(period_range(F.col("_from"), F.col("_to"), grain)).alias("_day"))
    types = dict(panel.dtypes)
    return filled.select(
        *keys,
        F.col("_day").alias("ds"),
        *[F.when(F.col("_day") == F.col("ds"), F.col(m)).otherwise(F.lit(0).cast(types[m])).alias(m)
          for m in measures],
    )


def trim_partial(df: DataFrame, grain: str, last_complete: Column, first_complete: Column | None = None,
                 date: str = "ds") -> DataFrame:
    """Keep rows dated inside complete periods; works on lines and on panels."""
    df = df.filter(F.col(date) < shift(last_complete, 1, grain))
    return df if first_complete is None else df.filter(F.col(date) >= first_complete)


def hierarchy(panel: DataFrame, parent: str = "region_key", child: str = "nation_key") -> DataFrame:
    """Total, parent and child levels of a panel in one table."""
    return (
        panel.groupingSets([["ds"], ["ds", parent], ["ds", parent, child]], "ds", parent, child)
        .agg(
            F.grouping_id().alias("_level"),
            exact_sum("y").cast("double").alias("y"),
            exact_sum("units").cast("double").alias("units"),
            F.sum("n_orders").alias("n_orders"),
        )
        .select(
            F.when(F.col("_level") == 0, child).when(F.col("_level") == 1, parent).otherwise("total").alias("level"),
            parent, child, "ds", "y", "units", "n_orders",
        )
    )


def pareto(panel: DataFrame, keys, a_share: float = 0.8, b_share: float = 0.95) -> DataFrame:
    """A, B or C class of each series by cumulative share of revenue.

    Series are ranked by revenue, then by key. The running share includes the
    series itself; the series that crosses a limit belongs to the better class.
    """
    keys = list(keys)
    totals = panel.groupBy(*keys).agg(exact_sum("y").alias("revenue"))
    ranked = running_totals(
        totals, [F.col("revenue").desc(), *[F.col(k) for k in keys]],
        {"_upto": F.col("revenue"), "position": F.lit(1).cast("bigint")},
    )
    whole = F.col("_upto_total").cast("double")
    before = F.try_divide((F.col("_upto") - F.col("revenue")).cast("double"), whole)
    return ranked.select(
        *keys,
        F.col("revenue").cast("double").alias("revenue"),
        "position",
        F.try_divide(F.col("_upto").cast("double"), whole).alias("cum_share"),
        F.when(before < a_share, "A").when(before < b_share, "B").otherwise("C").alias("abc"),
    )


def top_series(panel: DataFrame, keys, n: int, parent: str | None = None) -> DataFrame:
    """The ``n`` largest series by revenue, overall or inside each parent.

    Inside parents the best of pieces come first, which a hash of the series deals out, and then the best of
    these: a parent that holds most of the series is spread over as many tasks as a shuffle has.
    """
    keys = list(keys)
    totals = panel.groupBy(*keys).agg(exact_sum("y").alias("revenue"))
    order = [F.col("revenue").desc(), *[F.col(k) for k in keys]]
    if parent is None:
        top = totals.orderBy(*order).limit(n)
        ranked = top.withColumn("position", F.row_number().over(W.orderBy(*order)))
    else:
        pieces = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranked = totals.withColumn("_piece", F.pmod(F.xxhash64(*keys), F.lit(pieces)))
        for inside in ([parent, "_piece"], [parent]):
            place = F.row_number().over(W.partitionBy(*inside).orderBy(*order))
            ranked = ranked.withColumn("position", place).filter(F.col("position") <= n)
    return ranked.select(*keys, F.col("revenue").cast("double").alias("revenue"), "position")


def winsorize(panel: DataFrame, keys, lo: float, hi: float, train_end: Column | None = None,
              column: str = "y") -> DataFrame:
    """Clip ``column`` to each series' own training quantiles and flag the clipped rows.

    A series has at most one row per calendar period, so its exact quantiles are
    computed in the window that the features share.
    """
    value = F.col(column)
    if train_end is not None:
        value = F.when(F.col("ds") <= train_end, value)
    limits = F.percentile(value, F.array(F.lit(lo), F.lit(hi))).over(W.partitionBy(*keys))
    with_limits = panel.withColumn("_limits", limits).select(
        "*", F.col("_limits")[0].alias("clip_lo"), F.col("_limits")[1].alias("clip_hi"))
    clipped = F.least(F.greatest(F.col(column), F.col("clip_lo")), F.col("clip_hi"))
    return with_limits.select(
        *panel.columns, "clip_lo", "clip_hi",
        clipped.alias(f"{column}_clipped"),
        (clipped != F.col(column)).alias("clipped"),
    )


def demand_profile(panel: DataFrame, keys, column: str = "y") -> DataFrame:
    """Demand interval and squared variation per series, and the demand class."""
    sold = F.when(F.col(column) > 0, F.col(column))
    per_series = panel.groupBy(*keys).agg(
        F.count("*").alias("periods"),
        F.count(sold).alias("active"),
        F.try_divide(F.count("*").cast("double"), F.count(sold).cast("double")).alias("adi"),
        F.pow(F.try_divide(F.stddev_pop(sold), F.avg(sold)), 2).alias("cv2"),
    )
    return per_series.withColumn(
        "demand_class",
        F.when(F.col("active") == 0, "none")
        .when((F.col("adi") < ADI_CUT) & (F.col("cv2") < CV2_CUT), "smooth")
        .when(F.col("adi") < ADI_CUT, "erratic")
        .when(F.col("cv2") < CV2_CUT, "intermittent")
        .otherwise("lumpy"),
    )
