"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.backtest import backtest_baselines
from ..plans.panels import dense_panel, period_bounds
from ..sources.sales import read_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL giving the same rows where there is one."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


# Shape of the backtests that the evaluation queries run on.
FOLDS, HORIZON, SEASON, WIDTH = 3, 12, 12, 12

SALES = """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, c_nationkey AS nation_key, n_regionkey AS region_key, p_brand AS brand,
         c_mktsegment AS segment, o_custkey AS customer_key, o_orderkey AS order_key, l_quantity AS qty,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(l_discount AS DECIMAL(18,2)) AS discount,
         l_returnflag = 'R' AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey)"""


def period_sql(date: str, grain: str) -> str:
    return f"CAST(date_trunc('{grain}', {date}) AS DATE)"


def bounds_sql(grain: str) -> str:
    low, high = period_sql("lo", grain), period_sql("hi + 1", grain)
    return f"""bounds AS (
  SELECT CAST(CASE WHEN {low} = lo THEN lo ELSE {low} + INTERVAL 1 {grain} END AS DATE) AS first_ds,
         CAST({high} - INTERVAL 1 {grain} AS DATE) AS last_ds, CAST({high} AS DATE) AS next_ds
  FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))"""


def raw_sql(keys: str, grain: str, where: str = "TRUE") -> str:
    return f"""raw AS (
  SELECT {keys}, {period_sql('ds', grain)} AS ds, CAST(sum(gross * (1 - discount)) AS DOUBLE) AS y,
         CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS units, count(DISTINCT order_key) AS n_orders,
         CAST(sum(discount) AS DOUBLE) / count(discount) AS avg_discount
  FROM sales, bounds WHERE sales.ds >= first_ds AND sales.ds < next_ds AND {where} GROUP BY ALL)"""


def panel_sql(keys: str = "nation_key", grain: str = "month", where: str = "TRUE") -> str:
    """The CTEs up to ``panel``, the dense table of series and periods."""
    return f"""WITH {SALES}, {bounds_sql(grain)}, {raw_sql(keys, grain, where)},
days AS (SELECT CAST(unnest(generate_series(first_ds, last_ds, INTERVAL 1 {grain})) AS DATE) AS ds FROM bounds),
series AS (SELECT DISTINCT {keys} FROM raw),
panel AS (
  SELECT {keys}, ds, coalesce(y, 0) AS y, coalesce(units, 0) AS units,
         coalesce(n_orders, 0) AS n_orders, coalesce(avg_discount, 0) AS avg_discount
  FROM (SELECT * FROM series CROSS JOIN days) LEFT JOIN raw USING ({keys}, ds))"""


PANEL = panel_sql()

BACKTEST = f"""{PANEL},
folds AS (
  SELECT CAST(f AS INTEGER) AS fold, CAST(last_ds - to_months({HORIZON} + {FOLDS} - f) AS DATE) AS origin
  FROM bounds, (SELECT CAST(unnest(range(1, {FOLDS} + 1)) AS INTEGER) AS f)),
spots AS (
  SELECT nation_key, fold, origin, ds, CAST(datediff('month', origin, ds) AS INTEGER) AS horizon, y
  FROM panel JOIN folds ON ds > origin AND ds <= origin + INTERVAL {HORIZON} MONTH),
fitted AS (
  SELECT nation_key, fold,
    CAST(sum(CASE WHEN ds > origin - INTERVAL {WIDTH} MONTH THEN CAST(y AS DECIMAL(38,4)) END) AS DOUBLE) / {WIDTH} AS mean_y,
    regr_slope(y, datediff('month', DATE '1970-01-01', ds)) AS slope,
    regr_intercept(y, datediff('month', DATE '1970-01-01', ds)) AS intercept
  FROM panel JOIN folds ON ds <= origin GROUP BY ALL),
backtest AS (
  SELECT s.nation_key, s.fold, origin, s.ds, horizon, 'seasonal_naive' AS model, s.y, p.y AS yhat
  FROM spots s JOIN panel p ON p.nation_key = s.nation_key AND p.ds = s.ds - INTERVAL {SEASON} MONTH
  UNION ALL
  SELECT s.nation_key, s.fold, origin, s.ds, horizon, 'moving_average', s.y, mean_y
  FROM spots s JOIN fitted f ON f.nation_key = s.nation_key AND f.fold = s.fold
  UNION ALL
  SELECT s.nation_key, s.fold, origin, s.ds, horizon, 'linear_trend', s.y,
         intercept + slope * datediff('month', DATE '1970-01-01', s.ds)
  FROM spots s JOIN fitted f ON f.nation_key = s.nation_key AND f.fold = s.fold)"""

# Error measures over rows with y and yhat, rounded where the engines add
# floating point numbers in different orders.
ERRORS = """count(*) AS n, round(avg(abs(yhat - y)), 3) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 3) AS rmse,
  round(sum(abs(yhat - y)) / nullif(sum(abs(y)), 0), 8) AS wape,
  round(avg(abs(yhat - y) / nullif(abs(y), 0)), 6) AS mape,
  round(avg(2 * abs(yhat - y) / nullif(abs(y) + abs(yhat), 0)), 8) AS smape, round(avg(yhat - y), 3) AS bias"""

ERROR_PLACES = {"mae": 3, "rmse": 3, "wape": 8, "mape": 6, "smape": 8, "bias": 3}


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Round columns, with negative zero turned into zero."""
    return df.select(*[
        (F.round(c, places[c]) + F.lit(0.0)).alias(c) if c in places else F.col(c) for c in df.columns
    ])


def nation_panel(spark: SparkSession, path: str, keys=("nation_key",), grain: str = "month",
                 exclude_returns: bool = False) -> DataFrame:
    return dense_panel(read_tables(spark, path), list(keys), grain, exclude_returns)


def last_month(spark: SparkSession, path: str):
    return period_bounds(read_tables(spark, path), "month")[1]


def nation_regions(spark: SparkSession, path: str) -> DataFrame:
    return read_tables(spark, path).nation.select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key"))


def nation_backtest(spark: SparkSession, path: str) -> DataFrame:
    """Baseline forecasts of all folds, the table the evaluation queries read."""
    return backtest_baselines(
        nation_panel(spark, path), ["nation_key"], "month", FOLDS, HORIZON, 1, SEASON, WIDTH, last_month(spark, path))
