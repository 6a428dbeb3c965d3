"""Queries over accuracy, intervals, reconciliation and serving frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import shift
from ..operators import evaluate as E
from ..operators import intervals as I
from ..operators import reconcile as R
from ..operators.baselines import BASELINES, seasonal_naive
from ..operators.joins import attach
from ..operators.splits import fold_origin
from ..session import materialize
from .base import (
    BACKTEST, ERROR_PLACES, ERRORS, FOLDS, HORIZON, PANEL, SEASON, last_month, nation_backtest, nation_panel,
    nation_regions, panel_sql, query, rounded,
)

K = ["nation_key"]


@query("metrics", f"{BACKTEST} SELECT model, {ERRORS} FROM backtest GROUP BY model")
def metrics(spark, path):
    return rounded(E.metrics(nation_backtest(spark, path), ["model"]), ERROR_PLACES)


@query("metrics_by_series", f"{BACKTEST} SELECT nation_key, model, {ERRORS} FROM backtest GROUP BY ALL")
def metrics_by_series(spark, path):
    return rounded(E.metrics(nation_backtest(spark, path), ["nation_key", "model"]), ERROR_PLACES)


@query("metrics_total", f"{BACKTEST} SELECT {ERRORS} FROM backtest")
def metrics_total(spark, path):
    return rounded(E.metrics(nation_backtest(spark, path)), ERROR_PLACES)


@query("mase", f"""{BACKTEST},
misses AS (
  SELECT p.nation_key, abs(p.y - lag(p.y, {SEASON}) OVER (PARTITION BY p.nation_key ORDER BY p.ds)) AS miss
  FROM panel p, folds WHERE fold = 1 AND p.ds <= origin),
scales AS (SELECT nation_key, avg(miss) AS scale FROM misses GROUP BY ALL),
maes AS (SELECT nation_key, model, avg(abs(yhat - y)) AS mae FROM backtest GROUP BY ALL)
SELECT nation_key, model, round(mae, 3) AS mae, round(scale, 3) AS scale, round(mae / nullif(scale, 0), 8) AS mase
FROM maes LEFT JOIN scales USING (nation_key)""")
def mase(spark, path):
    origin = fold_origin(last_month(spark, path), 1, FOLDS, HORIZON, 1, 0, "month")
    train = nation_panel(spark, path).filter(F.col("ds") <= origin)
    scores = E.mase(nation_backtest(spark, path), train, K, SEASON, ["model"])
    return rounded(scores, {"mae": 3, "scale": 3, "mase": 8})


@query("metrics_cube", f"""{BACKTEST},
placed AS (SELECT b.*, n_regionkey AS region_key FROM backtest b LEFT JOIN nation ON nation_key = n_nationkey)
SELECT model, horizon, region_key,
  concat_ws(',', CASE WHEN grouping(horizon) = 0 THEN 'horizon' END,
                 CASE WHEN grouping(region_key) = 0 THEN 'region_key' END) AS grouped_by, {ERRORS}
FROM placed GROUP BY GROUPING SETS ((model), (model, horizon), (model, region_key), (model, horizon, region_key))""")
def metrics_cube(spark, path):
    rows = attach(nation_backtest(spark, path), nation_regions(spark, path), K, "left")
    return rounded(E.metrics_cube(rows, ["horizon", "region_key"]), ERROR_PLACES)


@query("leaderboard", f"""{BACKTEST},
scores AS (
  SELECT nation_key, model, sum(abs(yhat - y)) / nullif(sum(abs(y)), 0) AS wape FROM backtest GROUP BY ALL)
SELECT nation_key, model, round(wape, 8) AS wape FROM scores
QUALIFY row_number() OVER (PARTITION BY nation_key ORDER BY wape NULLS LAST, model) = 1""")
def leaderboard(spark, path):
    scores = E.metrics(nation_backtest(spark, path), ["nation_key", "model"])
    return rounded(E.leaderboard(scores, K), {"wape": 8})


@query("worst_series", f"""{BACKTEST}
SELECT nation_key, model, {ERRORS} FROM backtest GROUP BY nation_key, model
ORDER BY avg(abs(yhat - y)) DESC, nation_key, model LIMIT 5""")
def worst_series(spark, path):
    keys = [*K, "model"]
    return rounded(E.worst_series(E.metrics(nation_backtest(spark, path), keys), keys, 5), ERROR_PLACES)


@query("residual_acf", f"""{PANEL},
errors AS (SELECT nation_key, ds, y - lag(y, 12) OVER (PARTITION BY nation_key ORDER BY ds) AS e FROM panel),
lagged AS (
  SELECT nation_key, e, {', '.join(f'lag(e, {k}) OVER (PARTITION BY nation_key ORDER BY ds) AS e_{k}' for k in (1, 12))}
  FROM errors)
SELECT nation_key, round(corr(e, e_1), 8) AS acf_1, round(corr(e, e_12), 8) AS acf_12 FROM lagged GROUP BY nation_key""")
def residual_acf(spark, path):
    rows = seasonal_naive(nation_panel(spark, path), K, 12)
    return rounded(E.residual_acf(rows, K, [1, 12]), {"acf_1": 8, "acf_12": 8})


@query("residual_acf_backtest", f"""{BACKTEST},
lagged AS (
  SELECT nation_key, model, fold, y - yhat AS e,
    lag(y - yhat, 1) OVER (PARTITION BY nation_key, model, fold ORDER BY ds) AS e_1 FROM backtest)
SELECT nation_key, model, fold, round(corr(e, e_1), 8) AS acf_1 FROM lagged GROUP BY ALL""")
def residual_acf_backtest(spark, path):
    rows = E.residual_acf(nation_backtest(spark, path), K, [1], ["model", "fold"])
    return rounded(rows, {"acf_1": 8})


@query("residual_interval", f"""{BACKTEST}
SELECT nation_key, model, round(quantile_cont(y - yhat, 0.1), 2) AS q_lo, round(quantile_cont(y - yhat, 0.9), 2) AS q_hi
FROM backtest GROUP BY ALL""")
def residual_interval(spark, path):
    limits = I.residual_interval(nation_backtest(spark, path), ["nation_key", "model"])
    return rounded(limits, {"q_lo": 2, "q_hi": 2})


@query("pooled_interval", f"""{BACKTEST}
SELECT horizon, model, round(quantile_cont(y - yhat, 0.1), 2) AS q_lo, round(quantile_cont(y - yhat, 0.9), 2) AS q_hi
FROM backtest GROUP BY ALL""")
def pooled_interval(spark, path):
    limits = I.residual_interval(nation_backtest(spark, path), ["horizon", "model"], pooled=True)
    return rounded(limits, {"q_lo": 2, "q_hi": 2})


# Limits from the earlier folds, applied to the forecasts of the last one.
_LIMITED = f"""{BACKTEST},
limits AS (
  SELECT nation_key, model, quantile_cont(y - yhat, 0.1) AS q_lo, quantile_cont(y - yhat, 0.9) AS q_hi
  FROM backtest WHERE fold < {FOLDS} GROUP BY nation_key, model),
limited AS (
  SELECT nation_key, model, ds, horizon, y, yhat, yhat + q_lo AS lo, yhat + q_hi AS hi
  FROM backtest LEFT JOIN limits USING (nation_key, model) WHERE fold = {FOLDS})"""


def _limited(spark, path):
    """Every model's forecasts of the last fold, with its limits; the backtest is stored and read twice."""
    rows, by = materialize(nation_backtest(spark, path)), [*K, "model"]
    limits = I.residual_interval(rows.filter(F.col("fold") < FOLDS), by)
    return I.with_interval(rows.filter(F.col("fold") == FOLDS), limits, by)


@query("coverage", f"""{_LIMITED}
SELECT model, horizon, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 9) AS coverage
FROM limited GROUP BY model, horizon""")
def coverage(spark, path):
    return rounded(I.coverage(_limited(spark, path), ["model", "horizon"]), {"coverage": 9})


_PLACED = f"""{BACKTEST},
placed AS (
  SELECT model, fold, origin, horizon, ds, n_regionkey AS region_key, nation_key, yhat
  FROM backtest LEFT JOIN nation ON nation_key = n_nationkey)"""

RUN = ["model", "fold", "origin", "horizon", "ds"]


def _placed(spark, path):
    rows = nation_backtest(spark, path)
    return attach(rows, nation_regions(spark, path), K, "left")


@query("bottom_up", f"""{_PLACED}
SELECT CASE WHEN grouping(nation_key) = 0 THEN 'nation_key' WHEN grouping(region_key) = 0 THEN 'region_key'
            ELSE 'total' END AS level, region_key, nation_key, model, fold, origin, horizon, ds,
  round(CAST(sum(CAST(yhat AS DECIMAL(38,4))) AS DOUBLE), 2) + 0.0 AS yhat
FROM placed GROUP BY GROUPING SETS ((model, fold, origin, horizon, ds), (model, fold, origin, horizon, ds, region_key),
  (model, fold, origin, horizon, ds, region_key, nation_key))""")
def bottom_up(spark, path):
    return rounded(R.bottom_up(_placed(spark, path), run=RUN), {"yhat": 2})


@query("top_down", f"""{_PLACED},
children AS (
  SELECT n_regionkey AS region_key, nation_key, sum(CAST(y AS DECIMAL(38,4))) AS y
  FROM panel JOIN nation ON nation_key = n_nationkey GROUP BY ALL),
shares AS (
  SELECT region_key, nation_key, CAST(y AS DOUBLE) / CAST(sum(y) OVER (PARTITION BY region_key) AS DOUBLE) AS share
  FROM children)
SELECT model, fold, region_key, ds, horizon, nation_key, share, round(yhat * share, 2) AS yhat
FROM (
  SELECT model, fold, region_key, ds, horizon, CAST(sum(CAST(yhat AS DECIMAL(38,4))) AS DOUBLE) AS yhat FROM placed GROUP BY ALL)
JOIN shares USING (region_key)""")
def top_down(spark, path):
    whole = R.bottom_up(_placed(spark, path), run=RUN).filter(F.col("level") == "region_key")
    train = attach(nation_panel(spark, path), nation_regions(spark, path), K, "left")
    split = R.top_down(whole.select("model", "fold", "region_key", "ds", "horizon", "yhat"), train)
    return rounded(split, {"yhat": 2})


@query("top_down_childless", f"""{_PLACED},
children AS (
  SELECT n_regionkey AS region_key, nation_key, sum(CAST(y AS DECIMAL(38,4))) AS y
  FROM panel JOIN nation ON nation_key = n_nationkey GROUP BY ALL),
shares AS (
  SELECT region_key, nation_key, CAST(y AS DOUBLE) / CAST(sum(y) OVER (PARTITION BY region_key) AS DOUBLE) AS share
  FROM children)
SELECT model, fold, region_key, ds, horizon, nation_key, coalesce(share, 1) AS share, round(yhat * coalesce(share, 1), 2) AS yhat
FROM (
  SELECT model, fold, region_key, ds, horizon, CAST(sum(CAST(yhat AS DECIMAL(38,4))) AS DOUBLE) AS yhat FROM placed
  GROUP BY GROUPING SETS ((model, fold, region_key, ds, horizon), (model, fold, ds, horizon)))
LEFT JOIN shares USING (region_key)""")
def top_down_childless(spark, path):
    """Regions are split; the total has no children of its own, so its forecast stays whole."""
    whole = R.bottom_up(_placed(spark, path), run=RUN).filter(F.col("level") != "nation_key")
    train = attach(nation_panel(spark, path), nation_regions(spark, path), K, "left")
    return rounded(R.top_down(whole.select("model", "fold", "region_key", "ds", "horizon", "yhat"), train), {"yhat": 2})


@query("future_frame", f"""{panel_sql('nation_key, segment')}
SELECT nation_key, segment, CAST(max(ds) + to_months(h) AS DATE) AS ds
FROM panel, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS h) GROUP BY nation_key, segment, h""")
def future_frame(spark, path):
    keys = ("nation_key", "segment")
    return R.future_frame(nation_panel(spark, path, keys), keys, 6, "month")


@query("actual_vs_forecast", f"""{_LIMITED},
actuals AS (
  SELECT nation_key, model, panel.ds, y FROM panel, bounds, (SELECT DISTINCT model FROM backtest)
  WHERE panel.ds > last_ds - INTERVAL 15 MONTH AND panel.ds <= last_ds - INTERVAL 3 MONTH)
SELECT coalesce(a.nation_key, l.nation_key) AS nation_key, coalesce(a.model, l.model) AS model, coalesce(a.ds, l.ds) AS ds, a.y, round(yhat, 2) AS yhat,
  round(lo, 2) AS lo, round(hi, 2) AS hi, round(a.y - yhat, 2) AS variance,
  round((a.y - yhat) / nullif(yhat, 0), 8) AS variance_rate,
  CASE WHEN l.ds IS NULL THEN 'actual only' WHEN a.ds IS NULL THEN 'forecast only' ELSE 'both' END AS status,
  NOT (a.y BETWEEN lo AND hi) AS outside
FROM actuals a FULL JOIN limited l ON a.nation_key = l.nation_key AND a.model = l.model AND a.ds = l.ds""")
def actual_vs_forecast(spark, path):
    last = last_month(spark, path)
    actual = nation_panel(spark, path).filter(
        (F.col("ds") > shift(last, -15, "month")) & (F.col("ds") <= shift(last, -3, "month")))
    each = actual.withColumn("model", F.explode(F.array(*[F.lit(m) for m in BASELINES])))
    report = R.actual_vs_forecast(each, _limited(spark, path), [*K, "model"])
    return rounded(report, {"yhat": 2, "lo": 2, "hi": 2, "variance": 2, "variance_rate": 8})
