"""Queries over features, splits and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.gbt import log_target, unlog
from ..operators import baselines as B
from ..operators import features as X
from ..operators import splits as S
from .base import BACKTEST, PANEL, last_month, nation_backtest, nation_panel, panel_sql, query, rounded

K = ["nation_key"]
SERIES = "(PARTITION BY nation_key ORDER BY ds"
ROW = "nation_key, ds, y"


def _panel(spark, path):
    return nation_panel(spark, path).select("nation_key", "ds", "y")


@query("lags", f"""{PANEL} SELECT {ROW}, {', '.join(f'lag(y, {k}) OVER {SERIES}) AS y_lag_{k}' for k in (1, 2, 3, 12))}
FROM panel""")
def lags(spark, path):
    return X.lags(_panel(spark, path), K, "y", [1, 2, 3, 12])


def _full(fn, width):
    frame = f"{SERIES} ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(y) OVER {frame} >= {width} THEN {fn}(y) OVER {frame} END"


@query("rolling", f"""{PANEL} SELECT {ROW}, round({_full('avg', 12)}, 6) AS y_mean_12,
  round({_full('stddev_samp', 12)}, 2) AS y_std_12, {_full('min', 12)} AS y_min_12, {_full('max', 12)} AS y_max_12,
  round({_full('sum', 12)}, 4) AS y_sum_12 FROM panel""")
def rolling(spark, path):
    rows = X.rolling(_panel(spark, path), K, "y", 12, ["mean", "std", "min", "max", "sum"])
    return rounded(rows, {"y_mean_12": 6, "y_std_12": 2, "y_sum_12": 4})


@query("expanding", f"""{PANEL} SELECT {ROW},
  round(avg(y) OVER {SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS y_expanding FROM panel""")
def expanding(spark, path):
    return rounded(X.expanding(_panel(spark, path), K, "y"), {"y_expanding": 1})


_WEIGHTS = [0.3 * 0.7 ** i for i in range(6)]


@query("ewma", f"""{PANEL} SELECT {ROW}, round({' + '.join(
    f'lag(y, {i + 1}) OVER {SERIES}) * CAST({w / sum(_WEIGHTS)!r} AS DOUBLE)' for i, w in enumerate(_WEIGHTS))}, 3)
  AS y_ewma FROM panel""")
def ewma(spark, path):
    return rounded(X.ewma(_panel(spark, path), K, "y", 0.3, 6), {"y_ewma": 3})


@query("growth", f"""{PANEL} SELECT {ROW},
  (lag(y, 1) OVER {SERIES}) - lag(y, 13) OVER {SERIES})) / nullif(lag(y, 13) OVER {SERIES}), 0) AS y_growth_12
FROM panel""")
def growth(spark, path):
    return X.growth(_panel(spark, path), K, "y", 12)


@query("calendar", f"""{panel_sql(grain='day')} SELECT nation_key, ds, CAST(year(ds) AS INTEGER) AS year,
  CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter, CAST(week(ds) AS INTEGER) AS week,
  CAST(dayofweek(ds) + 1 AS INTEGER) AS weekday, CAST(day(last_day(ds)) AS INTEGER) AS days_in_month,
  CAST(ds = last_day(ds) AS INTEGER) AS month_end FROM panel""")
def calendar(spark, path):
    return X.calendar(nation_panel(spark, path, grain="day").select("nation_key", "ds"))


@query("fourier", f"""{PANEL} SELECT {ROW}, {', '.join(
    f'round({f}(2 * {k} * pi() * month(ds) / 12), 9) + 0.0 AS {f}_{k}' for k in (1, 2) for f in ('sin', 'cos'))}
FROM panel""")
def fourier(spark, path):
    rows = X.fourier(_panel(spark, path), 12, 2)
    return rounded(rows, {f"{f}_{k}": 9 for f in ("sin", "cos") for k in (1, 2)})


@query("seasonal_index", f"""{PANEL},
months AS (SELECT nation_key, month(ds) AS m, avg(y) AS mean_y FROM panel WHERE ds < DATE '2000-08-01' GROUP BY ALL),
overall AS (SELECT nation_key, avg(y) AS all_y FROM panel WHERE ds < DATE '2000-08-01' GROUP BY ALL)
SELECT panel.nation_key, ds, y, round(coalesce(mean_y / nullif(all_y, 0), 1), 8) AS seasonal_index
FROM panel JOIN overall USING (nation_key) LEFT JOIN months ON months.nation_key = panel.nation_key AND m = month(ds)
""")
def seasonal_index(spark, path):
    rows = X.seasonal_index(_panel(spark, path), K, F.lit("2000-07-01").cast("date"))
    return rounded(rows, {"seasonal_index": 8})


@query("series_past_mean", f"""{PANEL} SELECT {ROW},
  round(avg(y) OVER {SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS nation_key_past_mean
FROM panel""")
def series_past_mean(spark, path):
    return rounded(X.target_encode_past(_panel(spark, path), "nation_key"), {"nation_key_past_mean": 1})


@query("brand_past_mean", f"""{panel_sql('nation_key, brand')},
per_period AS (SELECT brand, ds, sum(CAST(y AS DECIMAL(38,4))) AS s, count(*) AS n FROM panel GROUP BY ALL),
encoded AS (
  SELECT brand, ds, CAST(sum(s) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS past FROM per_period
  WINDOW w AS (PARTITION BY brand ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT nation_key, brand, ds, y, round(past, 1) AS brand_past_mean FROM panel JOIN encoded USING (brand, ds)""")
def brand_past_mean(spark, path):
    panel = nation_panel(spark, path, ("nation_key", "brand")).select("nation_key", "brand", "ds", "y")
    return rounded(X.target_encode_past(panel, "brand"), {"brand_past_mean": 1})


_DRIVERS = [(c, k) for c in ("units", "n_orders", "avg_discount") for k in (1, 12)]


@query("driver_lags", f"""{PANEL} SELECT nation_key, ds,
  {', '.join(f'lag({c}, {k}) OVER {SERIES}) AS {c}_lag_{k}' for c, k in _DRIVERS)} FROM panel""")
def driver_lags(spark, path):
    rows = X.driver_lags(nation_panel(spark, path), K, ["units", "n_orders", "avg_discount"], [1, 12])
    return rows.select("nation_key", "ds", *[f"{c}_lag_{k}" for c, k in _DRIVERS])


@query("index_keys", f"""{panel_sql('nation_key, segment')} SELECT nation_key, segment, ds, y,
  CAST(dense_rank() OVER (ORDER BY CAST(nation_key AS VARCHAR)) - 1 AS DOUBLE) AS nation_key_index,
  CAST(dense_rank() OVER (ORDER BY segment) - 1 AS DOUBLE) AS segment_index FROM panel""")
def index_keys(spark, path):
    panel = nation_panel(spark, path, ("nation_key", "segment")).select("nation_key", "segment", "ds", "y")
    return X.index_keys(panel, ["nation_key", "segment"])


@query("horizon_labels", f"""{PANEL},
lagged AS (SELECT nation_key, ds, lag(y, 1) OVER {SERIES}) AS y_lag_1 FROM panel),
steps AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS horizon)
SELECT f.nation_key, CAST(f.ds - INTERVAL 1 MONTH AS DATE) AS origin, horizon,
  CAST(f.ds + to_months(horizon - 1) AS DATE) AS ds, y_lag_1,
  CAST(month(f.ds + to_months(horizon - 1)) AS INTEGER) AS month, p.y AS label
FROM lagged f CROSS JOIN steps
LEFT JOIN panel p ON p.nation_key = f.nation_key AND p.ds = CAST(f.ds + to_months(horizon - 1) AS DATE)""")
def horizon_labels(spark, path):
    rows = X.lags(_panel(spark, path), K, "y", [1]).withColumn("month", F.month("ds"))
    return X.horizon_labels(rows, K, 3, "month")


@query("drop_warmup", f"""{PANEL},
lagged AS (SELECT {ROW}, lag(y, 12) OVER {SERIES}) AS y_lag_12 FROM panel)
SELECT * FROM lagged WHERE y_lag_12 IS NOT NULL""")
def drop_warmup(spark, path):
    return X.drop_warmup(X.lags(_panel(spark, path), K, "y", [12]), ["y_lag_12"])


@query("feature_table", f"""{PANEL},
built AS (
  SELECT {ROW}, {', '.join(f'lag(y, {k}) OVER {SERIES}) AS y_lag_{k}' for k in (1, 2, 3, 12))},
    round({_full('avg', 3)}, 6) AS y_mean_3, round({_full('avg', 12)}, 6) AS y_mean_12,
    CAST(month(ds) AS INTEGER) AS month
  FROM panel)
SELECT * FROM built WHERE y_lag_12 IS NOT NULL""")
def feature_table(spark, path):
    spec = X.FeatureSpec()
    rows = X.drop_warmup(spec.from_panel(_panel(spark, path), K), spec.names)
    return rounded(rows, {"y_mean_3": 6, "y_mean_12": 6})


@query("log_target", f"""{PANEL} SELECT {ROW}, round(ln(1 + y), 9) AS log_y, round(exp(ln(1 + y)) - 1, 4) AS back
FROM panel""")
def log_target_query(spark, path):
    rows = _panel(spark, path).withColumn("log_y", log_target())
    return rounded(rows.withColumn("back", unlog("log_y")), {"log_y": 9, "back": 4})


@query("holdout", f"""{PANEL} SELECT {ROW},
  CASE WHEN ds <= last_ds - INTERVAL 12 MONTH THEN 'train' ELSE 'test' END AS role FROM panel, bounds""")
def holdout(spark, path):
    train, test = S.holdout(_panel(spark, path), 12, "month", last_month(spark, path))
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


@query("rolling_origin", f"""{PANEL},
folds AS (
  SELECT fold, CAST(last_ds - to_months(CAST(6 + 1 + (4 - fold) * 3 AS INTEGER)) AS DATE) AS origin
  FROM bounds, (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS fold))
SELECT nation_key, ds, y, fold, CASE WHEN ds <= origin THEN 'train' ELSE 'test' END AS role
FROM panel JOIN folds ON ds <= origin OR (ds > origin + INTERVAL 1 MONTH AND ds <= origin + INTERVAL 7 MONTH)""")
def rolling_origin(spark, path):
    return S.rolling_origin(_panel(spark, path), 4, 6, step=3, gap=1, last=last_month(spark, path))


@query("seasonal_naive", f"{PANEL} SELECT {ROW}, lag(y, 12) OVER {SERIES}) AS yhat FROM panel")
def seasonal_naive(spark, path):
    return B.seasonal_naive(_panel(spark, path), K, 12)


@query("moving_average", f"{PANEL} SELECT {ROW}, round({_full('avg', 3)}, 6) AS yhat FROM panel")
def moving_average(spark, path):
    return rounded(B.moving_average(_panel(spark, path), K, 3), {"yhat": 6})


_MONTHS = "datediff('month', DATE '1970-01-01', ds)"


@query("linear_trend", f"""{PANEL} SELECT nation_key, round(regr_slope(y, {_MONTHS}), 4) AS slope,
  round(regr_intercept(y, {_MONTHS}), 2) AS intercept, count(*) AS n
FROM panel WHERE ds < DATE '2000-08-01' GROUP BY nation_key""")
def linear_trend(spark, path):
    fitted = B.linear_trend(_panel(spark, path), K, "month", F.lit("2000-07-01").cast("date"))
    return rounded(fitted, {"slope": 4, "intercept": 2})


@query("baseline_forecasts", f"""{BACKTEST}
SELECT nation_key, fold, origin, ds, horizon, model, y,
  CASE model WHEN 'seasonal_naive' THEN yhat WHEN 'moving_average' THEN round(yhat, 6) ELSE round(yhat, 2) END AS yhat
FROM backtest""")
def baseline_forecasts(spark, path):
    places = F.when(F.col("model") == "moving_average", F.round("yhat", 6)).when(
        F.col("model") == "linear_trend", F.round("yhat", 2)).otherwise(F.col("yhat"))
    return nation_backtest(spark, path).withColumn("yhat", places)
