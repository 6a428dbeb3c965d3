"""Queries over sources and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.measures import with_revenue
from ..operators import panel as P
from ..plans.panels import period_bounds
from ..session import new_path
from ..sources.forecasts import read_forecasts, write_forecasts
from ..sources.sales import SALES_SCHEMA, load_sales, read_tables, sales_quality
from .base import PANEL, SALES, bounds_sql, nation_backtest, nation_panel, panel_sql, period_sql, query, raw_sql, rounded
from .base import BACKTEST

ALL = ", ".join(SALES_SCHEMA.fieldNames())


@query("sales_lines", f"WITH {SALES} SELECT {ALL} FROM sales")
def sales_lines(spark, path):
    return load_sales(spark, path)


@query("sales_without_returns", f"WITH {SALES} SELECT {ALL} FROM sales WHERE NOT returned")
def sales_without_returns(spark, path):
    return load_sales(spark, path, exclude_returns=True)


@query("line_revenue", f"""WITH {SALES}
SELECT order_key, customer_key, gross, discount, gross * (1 - discount) AS revenue FROM sales""")
def line_revenue(spark, path):
    columns = ["order_key", "customer_key", "gross", "discount"]
    return with_revenue(load_sales(spark, path, columns=columns))


@query("sales_in_range", f"""WITH {SALES}
SELECT order_key, ds, gross FROM sales WHERE ds >= DATE '1997-01-01' AND ds < DATE '1998-01-01'""")
def sales_in_range(spark, path):
    return load_sales(spark, path, columns=["order_key", "ds", "gross"],
                      since=F.lit("1997-01-01").cast("date"), until=F.lit("1998-01-01").cast("date"))


def _links_sql(many, many_key, one, one_key, orphan, childless):
    return f"""SELECT '{orphan}' AS "check", count(*) AS n FROM {many}
  WHERE NOT EXISTS (SELECT 1 FROM {one} WHERE {one_key} = {many_key})
UNION ALL SELECT '{childless}', count(*) FROM {one}
  WHERE NOT EXISTS (SELECT 1 FROM {many} WHERE {one_key} = {many_key})"""


def _null_sql(table, columns):
    return "\nUNION ALL ".join(
        f"""SELECT 'null_{table}_{c}' AS "check", count(*) AS n FROM {table} WHERE {c} IS NULL""" for c in columns)


@query("sales_quality", "\nUNION ALL ".join([
    _null_sql("lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_discount"]),
    _null_sql("orders", ["o_orderkey", "o_custkey", "o_orderdate"]),
    """SELECT 'nonpositive_price' AS "check", count(*) AS n FROM lineitem WHERE l_extendedprice <= 0""",
    """SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1""",
    *[f"""SELECT 'finer_{c}', count(*) FROM lineitem WHERE CAST(CAST(l_{c} AS DECIMAL(18,2)) AS DOUBLE) <> l_{c}"""
      for c in ("quantity", "extendedprice", "discount")],
    """SELECT 'orders_in_partial_last_month', count(*) FROM orders,
  (SELECT CAST(max(o_orderdate) AS DATE) AS hi FROM orders)
  WHERE hi < last_day(hi) AND o_orderdate >= date_trunc('month', hi)""",
    _links_sql("lineitem", "l_orderkey", "orders", "o_orderkey", "lines_without_order", "orders_without_lines"),
    _links_sql("orders", "o_custkey", "customer", "c_custkey", "orders_without_customer", "customers_without_orders"),
    _links_sql("lineitem", "l_partkey", "part", "p_partkey", "lines_without_part", "parts_without_lines"),
    _links_sql("customer", "c_nationkey", "nation", "n_nationkey",
               "customers_without_nation", "nations_without_customers"),
    _links_sql("nation", "n_regionkey", "region", "r_regionkey", "nations_without_region", "regions_without_nations"),
]))
def quality(spark, path):
    return sales_quality(read_tables(spark, path))


@query("forecast_store", f"""{BACKTEST}
SELECT nation_key, model, fold, ds, horizon, y, round(yhat, 2) AS yhat, 'b2' AS run_id FROM backtest WHERE fold = 2""")
def forecast_store(spark, path):
    """Two runs are stored, one of them twice; the rewritten one is read back."""
    rows = rounded(nation_backtest(spark, path).select("nation_key", "model", "fold", "ds", "horizon", "y", "yhat"), {"yhat": 2})
    stored = new_path(spark, "forecasts")
    write_forecasts(rows.filter(F.col("fold") == 1), stored, "b1")
    write_forecasts(rows, stored, "b2")
    write_forecasts(rows.filter(F.col("fold") == 2), stored, "b2")
    return read_forecasts(spark, stored, "b2")


def _by_period(keys, grain):
    def run(spark, path):
        tables = read_tables(spark, path)
        return P.revenue_panel(tables, list(keys), grain, bounds=period_bounds(tables, grain))
    return run


for _name, _keys, _grain in [
    ("revenue_monthly", ("nation_key",), "month"),
    ("revenue_weekly", ("region_key", "segment"), "week"),
    ("revenue_daily", ("nation_key",), "day"),
    ("revenue_brand_monthly", ("nation_key", "brand"), "month"),
    ("revenue_customer_monthly", ("customer_key",), "month"),
]:
    query(_name, f"""WITH {SALES}, {bounds_sql(_grain)}, {raw_sql(', '.join(_keys), _grain)}
SELECT * FROM raw""")(_by_period(_keys, _grain))


@query("revenue_from_lines", f"""WITH {SALES}
SELECT region_key, brand, {period_sql('ds', 'month')} AS ds, CAST(sum(gross * (1 - discount)) AS DOUBLE) AS y,
  CAST(sum(CAST(qty AS DECIMAL(18,2))) AS DOUBLE) AS units, count(DISTINCT order_key) AS n_orders,
  CAST(sum(discount) AS DOUBLE) / count(discount) AS avg_discount
FROM sales GROUP BY ALL""")
def revenue_from_lines(spark, path):
    columns = ["ds", "region_key", "brand", "order_key", "qty", "gross", "discount"]
    return P.revenue_by_period(load_sales(spark, path, columns=columns), ["region_key", "brand"], "month")


@query("panel_dense", f"{PANEL} SELECT * FROM panel")
def panel_dense(spark, path):
    return nation_panel(spark, path)


@query("panel_without_returns", f"{panel_sql(where='NOT returned')} SELECT * FROM panel")
def panel_without_returns(spark, path):
    return nation_panel(spark, path, exclude_returns=True)


@query("panel_dense_daily", f"{panel_sql(grain='day')} SELECT * FROM panel")
def panel_dense_daily(spark, path):
    return nation_panel(spark, path, grain="day")


@query("panel_dense_brand_weekly", f"{panel_sql('region_key, brand', 'week')} SELECT * FROM panel")
def panel_dense_brand_weekly(spark, path):
    return nation_panel(spark, path, ("region_key", "brand"), "week")


@query("trim_partial", f"""WITH {SALES}, {bounds_sql('month')}
SELECT order_key, ds, gross FROM sales, bounds WHERE ds >= first_ds AND ds < next_ds""")
def trim_partial(spark, path):
    first, last = period_bounds(read_tables(spark, path), "month")
    lines = load_sales(spark, path, columns=["order_key", "ds", "gross"])
    return P.trim_partial(lines, "month", last, first)


@query("hierarchy", f"""{panel_sql('region_key, nation_key')}
SELECT CASE WHEN grouping(nation_key) = 0 THEN 'nation_key' WHEN grouping(region_key) = 0 THEN 'region_key'
            ELSE 'total' END AS level, region_key, nation_key, ds,
  CAST(sum(CAST(y AS DECIMAL(38,4))) AS DOUBLE) AS y, CAST(sum(CAST(units AS DECIMAL(38,4))) AS DOUBLE) AS units,
  CAST(sum(n_orders) AS BIGINT) AS n_orders
FROM panel GROUP BY GROUPING SETS ((ds), (ds, region_key), (ds, region_key, nation_key))""")
def hierarchy(spark, path):
    return P.hierarchy(nation_panel(spark, path, ("region_key", "nation_key")))


@query("pareto", f"""{panel_sql('nation_key, brand')},
totals AS (SELECT nation_key, brand, sum(CAST(y AS DECIMAL(38,4))) AS revenue FROM panel GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER o AS position, sum(revenue) OVER (o ROWS UNBOUNDED PRECEDING) AS upto,
    CAST(sum(revenue) OVER () AS DOUBLE) AS whole
  FROM totals WINDOW o AS (ORDER BY revenue DESC, nation_key, brand))
SELECT nation_key, brand, CAST(revenue AS DOUBLE) AS revenue, position, CAST(upto AS DOUBLE) / whole AS cum_share,
  CASE WHEN CAST(upto - revenue AS DOUBLE) / whole < 0.8 THEN 'A'
       WHEN CAST(upto - revenue AS DOUBLE) / whole < 0.95 THEN 'B' ELSE 'C' END AS abc
FROM ranked""")
def pareto(spark, path):
    return P.pareto(nation_panel(spark, path, ("nation_key", "brand")), ["nation_key", "brand"])


@query("top_customers", f"""{panel_sql('customer_key')}
SELECT customer_key, CAST(sum(CAST(y AS DECIMAL(38,4))) AS DOUBLE) AS revenue,
  CAST(row_number() OVER (ORDER BY sum(CAST(y AS DECIMAL(38,4))) DESC, customer_key) AS INTEGER) AS position
FROM panel GROUP BY customer_key QUALIFY position <= 20""")
def top_customers(spark, path):
    tables = read_tables(spark, path)
    panel = P.revenue_panel(tables, ["customer_key"], "month", bounds=period_bounds(tables, "month"))
    return P.top_series(panel, ["customer_key"], 20)


@query("top_nations_by_region", f"""{panel_sql('region_key, nation_key')}
SELECT region_key, nation_key, CAST(sum(CAST(y AS DECIMAL(38,4))) AS DOUBLE) AS revenue,
  CAST(row_number() OVER (PARTITION BY region_key ORDER BY sum(CAST(y AS DECIMAL(38,4))) DESC, nation_key) AS INTEGER)
    AS position
FROM panel GROUP BY region_key, nation_key QUALIFY position <= 2""")
def top_nations_by_region(spark, path):
    panel = nation_panel(spark, path, ("region_key", "nation_key"))
    return P.top_series(panel, ["region_key", "nation_key"], 2, parent="region_key")


@query("winsorize", f"""{PANEL},
limits AS (
  SELECT nation_key, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi
  FROM panel WHERE ds < DATE '2000-08-01' GROUP BY nation_key)
SELECT nation_key, ds, y, round(lo, 5) AS clip_lo, round(hi, 5) AS clip_hi,
  round(least(greatest(y, lo), hi), 5) AS y_clipped, y < lo OR y > hi AS clipped
FROM panel JOIN limits USING (nation_key)""")
def winsorize(spark, path):
    panel = nation_panel(spark, path).select("nation_key", "ds", "y")
    clipped = P.winsorize(panel, ["nation_key"], 0.05, 0.95, F.lit("2000-07-01").cast("date"))
    return rounded(clipped, {"clip_lo": 5, "clip_hi": 5, "y_clipped": 5})


@query("demand_profile", f"""{panel_sql('nation_key, brand')},
profile AS (
  SELECT nation_key, brand, count(*) AS periods, count(CASE WHEN y > 0 THEN 1 END) AS active,
    CAST(count(*) AS DOUBLE) / nullif(count(CASE WHEN y > 0 THEN 1 END), 0) AS adi,
    pow(stddev_pop(CASE WHEN y > 0 THEN y END) / nullif(avg(CASE WHEN y > 0 THEN y END), 0), 2) AS cv2
  FROM panel GROUP BY ALL)
SELECT nation_key, brand, periods, active, round(adi, 8) AS adi, round(cv2, 8) AS cv2,
  CASE WHEN active = 0 THEN 'none' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic'
       WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS demand_class
FROM profile""")
def demand_profile(spark, path):
    keys = ("nation_key", "brand")
    return rounded(P.demand_profile(nation_panel(spark, path, keys), keys), {"adi": 8, "cv2": 8})
