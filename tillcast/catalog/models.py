"""Queries over the boosted model.

Models are checked exactly, on features whose every value is a candidate and with
leaves large enough that no two splits are alike: SQL grows the same trees level by
level, a split table per node, and boosts them over the rounds. Only the recursive
forecasts of a large model have no SQL form; tests compare them with a plain loop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.periods import shift
from ..models import gbt as M
from ..models import horizons as H
from ..operators.features import FeatureSpec, driver_lags, drop_warmup
from ..operators.splits import fold_origin, fold_rows, holdout
from ..plans.backtest import backtest as run_backtest
from ..plans.backtest import backtest_gbt, next_value_comparison
from ..plans.forecast import forecast_revenue as run_forecast
from ..plans.panels import period_bounds
from ..session import materialize, new_path
from ..sources.sales import read_tables
from .base import ERROR_PLACES, ERRORS, PANEL, last_month, nation_panel, panel_sql, query, rounded

K = ["nation_key"]
SPEC = FeatureSpec()
# All values of a number are candidates, and no leaf is so small that different splits would be alike: models that SQL can follow.
SMALL = M.GbtParams(trees=10, depth=3, bins=4096, min_rows=50)
STUMP = M.GbtParams(trees=1, depth=1, bins=2048)
LAG_ONLY = FeatureSpec(lags=(1,), means=(), calendar=())
INPUTS = M.Inputs(tuple(SPEC.names), tuple(K), "y", (*K, "ds"))


def _splits_sql(name: str, rows: str, features: str, label: str, by: str = "", after: str = "", least: int = 1) -> str:
    """CTEs for the split that explains most of ``label`` (within each ``by``):
    ``<name>`` has the feature, the threshold between two values, the means on
    both sides and the reduction of squared error.

    The trainer puts thresholds in the middle between neighbouring values of all training rows, not only of
    those in ``by``: ``after`` begins the names of CTEs ``<after>_<feature>`` that hold each value's next one.
    Splits that leave fewer than ``least`` rows on a side do not count."""
    by = f"{by}, " if by else ""
    known = {f: f"JOIN {after}_{f} t ON t.v = {rows}.{f}" if after and not f.endswith("_rank") else "" for f in features.split(", ")}
    per_feature = "\nUNION ALL ".join(
        f"SELECT {by}'{f}' AS feature, CAST({f} AS DOUBLE) AS v, {'any_value(t.after_v)' if join else 'CAST(NULL AS DOUBLE)'} AS after_v, "
        f"count(*) AS n, sum({label}) AS s FROM {rows} {join} GROUP BY ALL" for f, join in known.items())
    gain = ("s_left * s_left / n_left + (s_all - s_left) * (s_all - s_left) / (n_all - n_left) - s_all * s_all / n_all")
    return f"""{name}_values AS ({per_feature}),
{name}_sums AS (
  SELECT {by}feature, v, coalesce(after_v, lead(v) OVER o) AS next_v, sum(n) OVER o AS n_left, sum(s) OVER o AS s_left,
    sum(n) OVER (PARTITION BY {by}feature) AS n_all, sum(s) OVER (PARTITION BY {by}feature) AS s_all
  FROM {name}_values WINDOW o AS (PARTITION BY {by}feature ORDER BY v)),
{name} AS (
  SELECT {by}feature, (v + next_v) / 2 AS threshold, s_left / n_left AS left_mean,
    (s_all - s_left) / (n_all - n_left) AS right_mean, {gain} AS gain
  FROM {name}_sums WHERE n_left >= {least} AND n_all - n_left >= {least}
  QUALIFY row_number() OVER ({f"PARTITION BY {by[:-2]} " if by else ""}ORDER BY gain DESC, feature, v) = 1)"""


def _leaf(value: str) -> str:
    return f"CASE WHEN {value} <= threshold THEN left_mean ELSE right_mean END"


def _features(spark, path, spec=SPEC):
    return drop_warmup(spec.from_panel(nation_panel(spark, path), K), spec.names)


@query("split_gain", f"""{PANEL},
lagged AS (SELECT y, lag(y, 1) OVER (PARTITION BY nation_key ORDER BY ds) AS y_lag_1 FROM panel),
per_value AS (
  SELECT y_lag_1 AS threshold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM lagged
  WHERE y_lag_1 IS NOT NULL GROUP BY ALL),
sums AS (
  SELECT threshold, sum(n) OVER o AS n_left, sum(s) OVER o AS s_left, sum(n) OVER () AS n, sum(s) OVER () AS s,
    sum(ss) OVER () AS ss
  FROM per_value WINDOW o AS (ORDER BY threshold))
SELECT threshold, CAST(n_left AS BIGINT) AS n_left, CAST(n - n_left AS BIGINT) AS n_right,
  round((s_left * s_left / n_left + (s - s_left) * (s - s_left) / (n - n_left) - s * s / n) / (ss - s * s / n), 8) + 0.0
    AS gain_share
FROM sums WHERE n_left < n""")
def split_gain(spark, path):
    rows = LAG_ONLY.from_panel(nation_panel(spark, path), K)
    return rounded(M.split_gain(rows, "y_lag_1"), {"gain_share": 8})


# Two boosting rounds of one split on the month.
_BOOSTED = f"""{PANEL},
known AS (SELECT nation_key, ds, CAST(month(ds) AS INTEGER) AS month, y FROM panel),
{_splits_sql('first', 'known', 'month', 'y')},
once AS (
  SELECT known.*, CASE WHEN month <= threshold THEN left_mean ELSE right_mean END AS f1 FROM known, first),
residuals AS (SELECT *, 2 * (y - f1) AS r FROM once),
{_splits_sql('second', 'residuals', 'month', 'r')}
SELECT nation_key, ds, y, round(f1 + 0.1 * CASE WHEN month <= threshold THEN left_mean ELSE right_mean END, 2) AS yhat
FROM once, second"""


@query("boosted_stumps", _BOOSTED)
def boosted_stumps(spark, path):
    rows, model = _boosted(spark, path)
    return rounded(M.predict(model, rows).drop("month"), {"yhat": 2})


def _tree_sql(name: str, rows: str, numbers: list[str], categories: list[str], label: str, depth: int, known: str, least: int,
              after: str) -> str:
    """CTEs that grow one tree of ``depth`` levels on those of ``rows`` that are ``known``; ``<name>`` is ``rows`` with
    the mean of each row's leaf in the column of that name.

    Level by level the rows are given to the node that the splits above lead them to, and each node has its
    own split table. Categories are ordered by their mean label inside the node, and split along that order;
    one without known rows there goes with the last.
    """
    parts, source = [f"{name}_at_0 AS (SELECT *, 1 AS node FROM {rows})"], f"{name}_at_0"
    for level in range(depth):
        at = f"{name}_{level}"
        for c in categories:
            parts.append(f"""{at}_ranks_{c} AS (
  SELECT node, {c} AS category, CAST(row_number() OVER (PARTITION BY node ORDER BY avg({label}), {c}) AS DOUBLE) AS v
  FROM {source} WHERE {known} GROUP BY node, {c})""")
        placed = ", ".join(["s.*", *[f"coalesce(r_{c}.v, 1e9) AS {c}_rank" for c in categories]])
        joins = " ".join(f"LEFT JOIN {at}_ranks_{c} r_{c} ON r_{c}.node = s.node AND r_{c}.category = s.{c}" for c in categories)
        features = [*numbers, *[f"{c}_rank" for c in categories]]
        value = "CASE feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in features) + " END"
        dropped = f" EXCLUDE ({', '.join(f'{c}_rank' for c in categories)})" if categories else ""
        parts += [
            f"{at}_rows AS (SELECT {placed} FROM {source} s {joins})",
            f"{at}_known AS (SELECT * FROM {at}_rows WHERE {known})",
            _splits_sql(f"{at}_best", f"{at}_known", ", ".join(features), label, "node", after, least),
            f"""{name}_at_{level + 1} AS (
  SELECT r.*{dropped} REPLACE (CASE WHEN b.node IS NULL THEN r.node WHEN {value} <= threshold THEN 2 * r.node ELSE 2 * r.node + 1 END AS node)
  FROM {at}_rows r LEFT JOIN {at}_best b ON b.node = r.node)""",
        ]
        source = f"{name}_at_{level + 1}"
    parts.append(f"{name} AS (SELECT * EXCLUDE (node), avg(CASE WHEN {known} THEN {label} END) OVER (PARTITION BY node) AS {name} FROM {source})")
    return ",\n".join(parts)


def _forest_sql(name: str, rows: str, numbers: list[str], categories: list[str], label: str, params: M.GbtParams,
                known: str = "TRUE") -> str:
    """CTEs of boosting rounds: each tree is grown on twice what the trees before leave over. ``<name>`` is ``rows`` with
    ``yhat``, and ``<name>_gains`` has the feature and gain of every split. All values of a number are candidates."""
    parts = [f"""{name}_after_{f} AS (SELECT v, lead(v) OVER (ORDER BY v) AS after_v FROM (
  SELECT DISTINCT CAST({f} AS DOUBLE) AS v FROM {rows} WHERE {known}))""" for f in numbers]
    source, total = rows, ""
    for n in range(1, params.trees + 1):
        if n > 1:
            parts.append(f"{name}_left_{n} AS (SELECT *, 2 * ({label} - ({total})) AS rest_{n} FROM {source})")
            source = f"{name}_left_{n}"
        tree = f"{name}_tree_{n}"
        parts.append(_tree_sql(tree, source, numbers, categories, label if n == 1 else f"rest_{n}", params.depth, known,
                               params.min_rows, f"{name}_after"))
        source, total = tree, f"{total} + {params.step} * {tree}" if total else tree
    gains = "\nUNION ALL ".join(f"SELECT feature, gain FROM {name}_tree_{n}_{level}_best" for n in range(1, params.trees + 1)
                                for level in range(params.depth))
    return ",\n".join([*parts, f"{name} AS (SELECT *, {total} AS yhat FROM {source})", f"{name}_gains AS ({gains})"])


@query("boosted_trees", f"""{PANEL},
known AS (SELECT nation_key, ds, CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter, y FROM panel),
{_forest_sql('forest', 'known', ['month', 'quarter'], ['nation_key'], 'y', M.GbtParams(3, 2, 0.1))}
SELECT nation_key, ds, y, round(yhat, 2) AS yhat FROM forest""")
def boosted_trees(spark, path):
    """Three rounds of trees with two levels, on numbers and a category."""
    panel = nation_panel(spark, path)
    rows = materialize(panel.select("nation_key", "ds", F.month("ds").alias("month"), F.quarter("ds").alias("quarter"), "y"))
    model = M.fit_gbt(rows, M.Inputs(("month", "quarter"), tuple(K), "y", (*K, "ds")), M.GbtParams(trees=3, depth=2, step=0.1))
    return rounded(M.predict(model, rows).select("nation_key", "ds", "y", "yhat"), {"yhat": 2})


def _boosted(spark, path):
    rows = materialize(nation_panel(spark, path).select("nation_key", "ds", F.month("ds").alias("month"), "y"))
    params = M.GbtParams(trees=2, depth=1, step=0.1)
    return rows, M.fit_gbt(rows, M.Inputs(("month",), (), "y", (*K, "ds")), params)


@query("direct_stump", f"""{PANEL},
steps AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS horizon),
pairs AS (
  SELECT o.y AS y_lag_1, horizon, t.y AS label FROM panel o CROSS JOIN steps
  JOIN panel t ON t.nation_key = o.nation_key AND t.ds = CAST(o.ds + to_months(horizon) AS DATE)),
{_splits_sql('best', 'pairs', 'y_lag_1, horizon', 'label')}
SELECT nation_key, ds AS origin, CAST(ds + to_months(s.horizon) AS DATE) AS ds, s.horizon, 'gbt_direct' AS model,
  'model' AS status, round(CASE WHEN (CASE WHEN feature = 'y_lag_1' THEN y ELSE s.horizon END) <= threshold THEN left_mean ELSE right_mean
        END, 2) AS yhat
FROM panel CROSS JOIN steps s, bounds, best WHERE panel.ds = last_ds""")
def direct_stump(spark, path):
    """Direct forecasts of a model with a single split."""
    last = last_month(spark, path)
    table = materialize(H.horizon_table(nation_panel(spark, path), K, 3, "month", LAG_ONLY, last))
    rows, _ = H.forecast_direct(table, K, LAG_ONLY, last, STUMP, categories=())
    return rounded(rows.drop("lo", "hi"), {"yhat": 2})


@query("recursive_stump", f"""{PANEL},
pairs AS (
  SELECT o.y AS y_lag_1, t.y AS label FROM panel o
  JOIN panel t ON t.nation_key = o.nation_key AND t.ds = CAST(o.ds + INTERVAL 1 MONTH AS DATE)),
{_splits_sql('best', 'pairs', 'y_lag_1', 'label')},
one AS (SELECT nation_key, ds AS origin, threshold, left_mean, right_mean, {_leaf('y')} AS f1
        FROM panel, bounds, best WHERE ds = last_ds),
two AS (SELECT *, {_leaf('f1')} AS f2 FROM one),
three AS (SELECT *, {_leaf('f2')} AS f3 FROM two)
SELECT nation_key, origin, CAST(origin + to_months(h) AS DATE) AS ds, h AS horizon, 'gbt_recursive' AS model,
  'model' AS status, round(CASE h WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END, 2) AS yhat
FROM three, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS h)""")
def recursive_stump(spark, path):
    """Step-by-step forecasts of a model with a single split."""
    panel = materialize(nation_panel(spark, path))
    model = H.fit_step(panel, K, LAG_ONLY, STUMP, categories=())
    rows = H.forecast_recursive(model, panel, K, 3, "month", LAG_ONLY, last_month(spark, path))
    return rounded(rows.drop("lo", "hi"), {"yhat": 2})


# Series rows with the features of the small models, and the last year's start.
_KNOWN = f"""{PANEL},
known AS (
  SELECT nation_key, ds, y, CAST(month(ds) AS INTEGER) AS month, lag(y, 1) OVER o AS y_lag_1, lag(y, 12) OVER o AS y_lag_12
  FROM panel WINDOW o AS (PARTITION BY nation_key ORDER BY ds)),
cut AS (SELECT CAST(last_ds - INTERVAL 12 MONTH AS DATE) AS cut_ds FROM bounds)"""


@query("stump_comparison", f"""{_KNOWN},
train AS (SELECT known.* FROM known, cut WHERE ds <= cut_ds AND y_lag_12 IS NOT NULL),
{_splits_sql('best', 'train', 'y_lag_1, y_lag_12', 'y')},
scored AS (
  SELECT 'gbt' AS model, y, CASE WHEN (CASE WHEN feature = 'y_lag_1' THEN y_lag_1 ELSE y_lag_12 END) <= threshold
    THEN left_mean ELSE right_mean END AS yhat FROM known, cut, best WHERE ds > cut_ds
  UNION ALL SELECT 'seasonal_naive', y, y_lag_12 FROM known, cut WHERE ds > cut_ds)
SELECT model, {ERRORS} FROM scored GROUP BY model""")
def stump_comparison(spark, path):
    spec = FeatureSpec(lags=(1, 12), means=(), calendar=())
    out = next_value_comparison(read_tables(spark, path), K, spec=spec, params=STUMP, categories=())
    return rounded(out, ERROR_PLACES)


@query("log_stump", f"""{_KNOWN},
logs AS (SELECT *, ln(1 + y) AS log_y FROM known WHERE y_lag_1 IS NOT NULL),
{_splits_sql('best', 'logs', 'y_lag_1', 'log_y')}
SELECT nation_key, ds, y, round(greatest(exp({_leaf('y_lag_1')}) - 1, 0), 2) AS yhat FROM logs, best""")
def log_stump(spark, path):
    rows = materialize(_features(spark, path, LAG_ONLY).withColumn("log_y", M.log_target()))
    model = M.fit_gbt(rows, M.Inputs(("y_lag_1",), (), "log_y", (*K, "ds")), STUMP)
    return rounded(M.predict(model, rows).select("nation_key", "ds", "y", M.unlog().alias("yhat")), {"yhat": 2})


@query("stump_importance", f"""{_KNOWN},
rows_in AS (SELECT * FROM known WHERE y_lag_1 IS NOT NULL),
{_splits_sql('first', 'rows_in', 'month, y_lag_1', 'y')},
residuals AS (
  SELECT r.*, 2 * (y - CASE WHEN (CASE feature WHEN 'month' THEN month ELSE y_lag_1 END) <= threshold
    THEN left_mean ELSE right_mean END) AS e FROM rows_in r, first),
{_splits_sql('second', 'residuals', 'month, y_lag_1', 'e')},
gains AS (SELECT feature, gain FROM first UNION ALL SELECT feature, gain FROM second),
weights AS (
  SELECT f.feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains) AS importance
  FROM (SELECT unnest(['month', 'y_lag_1']) AS feature) f LEFT JOIN gains USING (feature) GROUP BY f.feature)
SELECT feature, round(importance, 8) AS importance,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS position FROM weights""")
def stump_importance(spark, path):
    rows = materialize(_features(spark, path, FeatureSpec(lags=(1,), means=(), calendar=("month",))))
    model = M.fit_gbt(rows, M.Inputs(("month", "y_lag_1"), (), "y", (*K, "ds")), M.GbtParams(2, 1, 0.1, 2048))
    return rounded(M.feature_importance(model, spark), {"importance": 8})


# Two rounds of one split on the month: after the second round the validation
# error must have gained one percent, or only the first tree is kept.
@query("early_stop_stump", f"""{_KNOWN},
train AS (SELECT known.* FROM known, cut WHERE ds <= cut_ds),
{_splits_sql('first', 'train', 'month', 'y')},
residuals AS (SELECT train.*, 2 * (y - {_leaf('month')}) AS e FROM train, first),
{_splits_sql('second', 'residuals', 'month', 'e')},
once AS (SELECT known.nation_key, known.ds, known.month, y, {_leaf('month')} AS f1 FROM known, first),
twice AS (SELECT nation_key, ds, y, f1, f1 + 0.1 * {_leaf('month')} AS f2 FROM once, second),
errors AS (
  SELECT avg((y - f1) * (y - f1)) AS e1, avg((y - f2) * (y - f2)) AS e2 FROM twice, cut WHERE ds > cut_ds),
kept AS (SELECT CASE WHEN e1 - e2 < 0.01 * greatest(e2, 0.01) THEN 1 ELSE 2 END AS trees FROM errors)
SELECT nation_key, ds, y, round(CASE trees WHEN 1 THEN f1 ELSE f2 END, 2) AS yhat, trees FROM twice, kept""")
def early_stop_stump(spark, path):
    panel = materialize(nation_panel(spark, path).select("nation_key", "ds", F.month("ds").alias("month"), "y"))
    train, valid = holdout(panel, 12, "month", last_month(spark, path))
    model = M.early_stop(train, valid, M.Inputs(("month",), (), "y", (*K, "ds")), M.GbtParams(2, 1, 0.1))
    scored = M.predict(model, panel).drop("month").withColumn("trees", F.lit(M.tree_count(model)))
    return rounded(scored, {"yhat": 2})


_TUNED = f"""{_KNOWN},
folds AS (
  SELECT fold, CAST(last_ds - to_months(CAST(6 + (2 - fold) * 6 AS INTEGER)) AS DATE) AS origin
  FROM bounds, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS fold)),
train AS (SELECT known.*, fold FROM known JOIN folds ON ds <= origin),
{_splits_sql('first', 'train', 'month', 'y', 'fold')},
residuals AS (SELECT train.*, 2 * (y - {_leaf('month')}) AS e FROM train JOIN first USING (fold)),
{_splits_sql('second', 'residuals', 'month', 'e', 'fold')},
tests AS (
  SELECT known.*, fold FROM known JOIN folds ON ds > origin AND ds <= origin + INTERVAL 6 MONTH),
once AS (SELECT fold, month, y, {_leaf('month')} AS f1 FROM tests JOIN first USING (fold)),
scored AS (
  SELECT fold, setting, CAST(step AS DOUBLE) AS step, y, f1 + step * {_leaf('month')} AS yhat
  FROM once JOIN second USING (fold), (VALUES (0, 0.1), (1, 0.5)) AS grid(setting, step)),
scores AS (
  SELECT CAST(setting AS INTEGER) AS setting, fold, 2 AS trees, 1 AS depth, step, {ERRORS},
    sum(abs(yhat - y)) / sum(abs(y)) AS raw_wape
  FROM scored GROUP BY ALL)"""


def _tune_stumps(spark, path):
    panel = nation_panel(spark, path).select("nation_key", "ds", F.month("ds").alias("month"), "y")
    rows, last = materialize(panel), last_month(spark, path)
    folds = [fold_rows(rows, fold_origin(last, f, 2, 6, 6, 0, "month"), 6, 0, "month") for f in (1, 2)]
    grid = M.param_grid(M.GbtParams(2, 1), step=[0.1, 0.5])
    return M.tune_gbt(folds, M.Inputs(("month",), (), "y", (*K, "ds")), grid)


@query("tune_stumps", f"{_TUNED} SELECT * EXCLUDE (raw_wape) FROM scores")
def tune_stumps(spark, path):
    return rounded(_tune_stumps(spark, path), ERROR_PLACES)


@query("tuned_stump", f"""{_TUNED}
SELECT setting, trees, depth, step, round(avg(raw_wape), 8) AS wape FROM scores
GROUP BY setting, trees, depth, step ORDER BY avg(raw_wape), setting LIMIT 1""")
def tuned_stump(spark, path):
    return rounded(M.best_setting(_tune_stumps(spark, path)), {"wape": 8})


def _direct_folds_sql(horizon: int, folds: str) -> str:
    """CTE ``direct``: stump forecasts of every fold, with the actual values."""
    return f"""{PANEL},
steps AS (SELECT CAST(unnest(range(1, {horizon + 1})) AS INTEGER) AS horizon),
cells AS (
  SELECT o.nation_key, o.ds AS origin, horizon, CAST(o.ds + to_months(horizon) AS DATE) AS ds, o.y AS y_lag_1, t.y AS label, level
  FROM (SELECT *, avg(y) OVER (PARTITION BY nation_key ORDER BY ds) AS level FROM panel) o CROSS JOIN steps
  LEFT JOIN panel t ON t.nation_key = o.nation_key AND t.ds = CAST(o.ds + to_months(horizon) AS DATE)),
folds AS (
  SELECT fold, CAST(last_ds - to_months(CAST(behind AS INTEGER)) AS DATE) AS fold_origin
  FROM bounds, (VALUES {folds}) AS f(fold, behind)),
train AS (SELECT cells.*, fold FROM cells JOIN folds ON ds <= fold_origin WHERE label IS NOT NULL),
{_splits_sql('best', 'train', 'y_lag_1, horizon', 'label', 'fold')},
direct AS (
  SELECT nation_key, CAST(fold AS INTEGER) AS fold, origin, ds, horizon, 'gbt_direct' AS model, label AS y,
    'model' AS status, nullif(level, 0) AS level, CASE WHEN (CASE feature WHEN 'y_lag_1' THEN y_lag_1 ELSE horizon END) <= threshold
      THEN left_mean ELSE right_mean END AS yhat
  FROM cells JOIN folds ON origin = fold_origin JOIN best USING (fold))"""


@query("backtest_stump", f"""{_direct_folds_sql(6, '(1, 12), (2, 6)')}
SELECT nation_key, fold, origin, ds, horizon, model, y, status, round(yhat, 2) AS yhat FROM direct""")
def backtest_stump(spark, path):
    rows = backtest_gbt(nation_panel(spark, path), K, "month", 2, 6, 6, LAG_ONLY, STUMP, last_month(spark, path), ())
    return rounded(rows, {"yhat": 2})


@query("forecast_stump", f"""{_direct_folds_sql(3, '(0, 0), (1, 6), (2, 3)')},
limited AS (
  SELECT *, quantile_cont(CASE WHEN fold > 0 THEN (y - yhat) / level END, 0.1) OVER h AS q_lo,
    quantile_cont(CASE WHEN fold > 0 THEN (y - yhat) / level END, 0.9) OVER h AS q_hi
  FROM direct WINDOW h AS (PARTITION BY horizon))
SELECT nation_key, origin, ds, horizon, model, status, round(yhat, 2) AS yhat, round(greatest(yhat + q_lo * level, 0), 2) AS lo,
  round(greatest(yhat + q_hi * level, 0), 2) AS hi FROM limited WHERE fold = 0""")
def forecast_stump(spark, path):
    """The whole forecasting job with models of a single split."""
    out = run_forecast(nation_panel(spark, path), K, "month", 3, 2, LAG_ONLY, STUMP, last=last_month(spark, path),
                       categories=())
    return rounded(out, {"yhat": 2, "lo": 2, "hi": 2})


# Folds whose origins lie 1 to 36 months after the start of the panel, and its end: the first have nothing to train on.
_HISTORIES = (1, 6, 12, 13, 24, 36)


@query("forecast_short_series", f"""{PANEL},
steps AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS horizon),
cells AS (
  SELECT o.nation_key, o.ds AS origin, horizon, CAST(o.ds + to_months(horizon) AS DATE) AS ds, y_lag_1, y_lag_12, t.y AS label, level,
    s.y AS seasonal
  FROM (
    SELECT nation_key, ds, y AS y_lag_1, lag(y, 11) OVER p AS y_lag_12, avg(y) OVER p AS level FROM panel
    WINDOW p AS (PARTITION BY nation_key ORDER BY ds)) o CROSS JOIN steps
  LEFT JOIN panel t ON t.nation_key = o.nation_key AND t.ds = CAST(o.ds + to_months(horizon) AS DATE)
  LEFT JOIN panel s ON s.nation_key = o.nation_key AND s.ds = CAST(o.ds + to_months(horizon - 12) AS DATE)),
folds AS (
  SELECT fold, CAST(first_ds + to_months(CAST(fold - 1 AS INTEGER)) AS DATE) AS fold_origin
  FROM bounds, (VALUES {', '.join(f'({n})' for n in _HISTORIES)}) AS f(fold) UNION ALL SELECT 0, last_ds FROM bounds),
train AS (SELECT cells.*, fold FROM cells JOIN folds ON ds <= fold_origin WHERE label IS NOT NULL AND y_lag_12 IS NOT NULL),
{_splits_sql('best', 'train', 'y_lag_1, y_lag_12, horizon', 'label', 'fold')},
rated AS (
  SELECT cells.*, folds.fold, CASE WHEN y_lag_12 IS NOT NULL AND threshold IS NOT NULL THEN
    CASE WHEN (CASE feature WHEN 'y_lag_1' THEN y_lag_1 WHEN 'y_lag_12' THEN y_lag_12 ELSE horizon END) <= threshold
      THEN left_mean ELSE right_mean END END AS model_value
  FROM cells JOIN folds ON origin = fold_origin LEFT JOIN best ON best.fold = folds.fold)
SELECT nation_key, CAST(fold AS INTEGER) AS fold, origin, ds, horizon, 'gbt_direct' AS model, label AS y,
  CASE WHEN model_value IS NOT NULL THEN 'model' WHEN seasonal IS NOT NULL THEN 'seasonal value' ELSE 'mean of past' END AS status,
  round(coalesce(model_value, seasonal, level), 2) AS yhat FROM rated""")
def forecast_short_series(spark, path):
    """Forecasts of all series from their first month on: by their mean, last year's value, and the model."""
    spec, panel = FeatureSpec(lags=(1, 12), means=(), calendar=()), nation_panel(spark, path)
    first, last = period_bounds(read_tables(spark, path), "month")
    table = materialize(H.horizon_table(panel, K, 3, "month", spec, last))
    folds = {0: last, **{n: shift(first, n - 1, "month") for n in _HISTORIES}}
    return rounded(H.backtest_direct(table, K, spec, folds, STUMP).drop("past_mean"), {"yhat": 2})


@query("gaps_stump", f"""{PANEL},
known AS (
  SELECT nation_key, ds, y, units_lag_12, CASE WHEN units_lag_12 IS NULL THEN 1.0 ELSE 0.0 END AS units_lag_12_missing
  FROM (SELECT *, lag(units, 12) OVER (PARTITION BY nation_key ORDER BY ds) AS units_lag_12 FROM panel)),
filled AS (
  SELECT *, coalesce(units_lag_12, (SELECT avg(units_lag_12) FROM known)) AS units_lag_12_filled FROM known),
{_splits_sql('best', 'filled', 'units_lag_12_filled, units_lag_12_missing', 'y')}
SELECT nation_key, ds, y, units_lag_12_missing > 0 AS gap, round(CASE WHEN (CASE feature WHEN 'units_lag_12_filled' THEN units_lag_12_filled
  ELSE units_lag_12_missing END) <= threshold THEN left_mean ELSE right_mean END, 2) AS yhat FROM filled, best""")
def gaps_stump(spark, path):
    """A model of a driver's value a year before, which every series lacks in its first year: no row is left out."""
    rows = materialize(driver_lags(nation_panel(spark, path), K, ["units"], [12]))
    model = M.fit_gbt(rows, M.Inputs(("units_lag_12",), (), "y", (*K, "ds"), imputed=("units_lag_12",)), STUMP)
    scored = M.predict(model, rows).withColumn("gap", F.col("units_lag_12").isNull())
    return rounded(scored.select("nation_key", "ds", "y", "gap", "yhat"), {"yhat": 2})


@query("forecast_customers", f"""{panel_sql('customer_key')},
steps AS (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS horizon),
halves AS (SELECT avg(y) AS left_mean, avg(CASE WHEN ds > first_ds THEN y END) AS right_mean FROM panel, bounds)
SELECT customer_key, ds AS origin, CAST(ds + to_months(s.horizon) AS DATE) AS ds, s.horizon, 'gbt_direct' AS model, 'model' AS status,
  round(CASE WHEN s.horizon = 1 THEN left_mean ELSE right_mean END, 2) AS yhat
FROM panel CROSS JOIN steps s, bounds, halves WHERE panel.ds = last_ds""")
def forecast_customers(spark, path):
    """More series than any list of categories should hold; the one split is that of the horizon."""
    spec = FeatureSpec(lags=(), means=(), calendar=())
    keys, last = ["customer_key"], last_month(spark, path)
    table = materialize(H.horizon_table(nation_panel(spark, path, keys), keys, 2, "month", spec, last))
    rows, _ = H.forecast_direct(table, keys, spec, last, STUMP)
    return rounded(rows.drop("lo", "hi"), {"yhat": 2})


# The features of ``SPEC``, and the last year's start.
_FEATURES = f"""{PANEL},
cut AS (SELECT CAST(last_ds - INTERVAL 12 MONTH AS DATE) AS cut_ds FROM bounds),
dated AS (
  SELECT nation_key, ds, y, CAST(month(ds) AS INTEGER) AS month, {', '.join(f'lag(y, {k}) OVER o AS y_lag_{k}' for k in SPEC.lags)},
    {', '.join(f'avg(y) OVER (o ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS y_mean_{w}' for w in SPEC.means)}
  FROM panel WINDOW o AS (PARTITION BY nation_key ORDER BY ds)),
features AS (SELECT dated.*, ds <= cut_ds AS train FROM dated, cut WHERE y_lag_12 IS NOT NULL)"""
_NAMES = list(SPEC.names)


@query("next_value_comparison", f"""{_FEATURES},
{_forest_sql('forest', 'features', _NAMES, [], 'y', SMALL, 'train')},
scored AS (
  SELECT 'gbt' AS model, y, yhat FROM forest WHERE NOT train UNION ALL SELECT 'seasonal_naive', y, y_lag_12 FROM features WHERE NOT train)
SELECT model, {ERRORS} FROM scored GROUP BY model""")
def comparison(spark, path):
    return rounded(next_value_comparison(read_tables(spark, path), K, params=SMALL), ERROR_PLACES)


@query("fit_gbt", f"""{_FEATURES},
{_forest_sql('forest', 'features', _NAMES, K, 'y', SMALL, 'train')}
SELECT nation_key, ds, y, round(yhat, 2) AS yhat FROM forest WHERE NOT train""")
def fit_gbt(spark, path):
    train, test = holdout(materialize(_features(spark, path)), 12, "month", last_month(spark, path))
    return rounded(M.predict(M.fit_gbt(train, INPUTS, SMALL), test).select("nation_key", "ds", "y", "yhat"), {"yhat": 2})


@query("feature_importance", f"""{_FEATURES},
{_forest_sql('forest', 'features', _NAMES, K, 'y', SMALL)},
weights AS (
  SELECT f.feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM forest_gains) AS importance
  FROM (SELECT unnest({[*[f'{k}_index' for k in K], *_NAMES]}) AS feature) f
  LEFT JOIN forest_gains g ON replace(g.feature, '_rank', '_index') = f.feature GROUP BY f.feature)
SELECT feature, round(importance, 8) AS importance,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS position FROM weights""")
def feature_importance(spark, path):
    found = M.feature_importance(M.fit_gbt(materialize(_features(spark, path)), INPUTS, SMALL), spark)
    return rounded(found, {"importance": 8})


EARLY = M.GbtParams(trees=12, depth=3, bins=4096, min_rows=50)
_ROUNDS = [" + ".join([f"forest_tree_{n}" if n == 1 else f"{EARLY.step} * forest_tree_{n}" for n in range(1, m + 1)]) for m in range(1, EARLY.trees + 1)]


# A further tree counts if the error of the validation rows falls by one percent; the first that does not ends the fit.
@query("early_stop", f"""{_FEATURES},
parted AS (
  SELECT * REPLACE (ds <= cut_ds - INTERVAL 12 MONTH AS train), ds > cut_ds - INTERVAL 12 MONTH AND ds <= cut_ds AS valid, ds > cut_ds AS test
  FROM features, cut),
{_forest_sql('forest', 'parted', _NAMES, K, 'y', EARLY, 'train')},
rounds AS (SELECT *, [{', '.join(_ROUNDS)}] AS after FROM forest),
errors AS (
  SELECT m, avg((y - after[m]) * (y - after[m])) AS e FROM (SELECT *, unnest(range(1, {EARLY.trees + 1})) AS m FROM rounds WHERE valid) GROUP BY m),
kept AS (
  SELECT coalesce(min(m) - 1, {EARLY.trees}) AS trees
  FROM (SELECT m, e, lag(e) OVER (ORDER BY m) AS before FROM errors) WHERE before - e < 0.01 * greatest(e, 0.01))
SELECT nation_key, ds, y, round(after[trees], 2) AS yhat, CAST(trees AS INTEGER) AS trees FROM rounds, kept WHERE test""")
def early_stop(spark, path):
    """Scores on the last year of a model stopped on the year before it."""
    known, test = holdout(materialize(_features(spark, path)), 12, "month", last_month(spark, path))
    train, valid = holdout(known, 12, "month")
    model = M.early_stop(train, valid, INPUTS, EARLY)
    return rounded(M.predict(model, test).select("nation_key", "ds", "y", "yhat").withColumn(
        "trees", F.lit(M.tree_count(model))), {"yhat": 2})


@query("log_model", f"""{_FEATURES},
logs AS (SELECT *, ln(1 + y) AS log_y FROM features),
{_forest_sql('forest', 'logs', _NAMES, K, 'log_y', SMALL, 'train')}
SELECT nation_key, ds, y, round(greatest(exp(yhat) - 1, 0), 2) AS yhat FROM forest WHERE NOT train""")
def log_model(spark, path):
    """A model of log revenue, with its forecasts turned back."""
    rows = _features(spark, path).withColumn("log_y", M.log_target())
    train, test = holdout(materialize(rows), 12, "month", last_month(spark, path))
    model = M.fit_gbt(train, M.Inputs(tuple(SPEC.names), tuple(K), "log_y", (*K, "ds")), SMALL)
    return rounded(M.predict(model, test).select("nation_key", "ds", "y", M.unlog().alias("yhat")), {"yhat": 2})


_GRID = M.param_grid(M.GbtParams(trees=5, bins=4096, min_rows=50), depth=[2, 4])
_TUNED_TREES = f"""{_FEATURES},
{','.join(f"""
rows_{f} AS (
  SELECT * REPLACE (ds <= last_ds - INTERVAL {12 - 6 * (f - 1)} MONTH AS train),
    ds > last_ds - INTERVAL {12 - 6 * (f - 1)} MONTH AND ds <= last_ds - INTERVAL {6 - 6 * (f - 1)} MONTH AS test FROM features, bounds),
{_forest_sql(f'forest_{f}_{i}', f'rows_{f}', _NAMES, K, 'y', params, 'train')}""" if i == 0 else f"""
{_forest_sql(f'forest_{f}_{i}', f'rows_{f}', _NAMES, K, 'y', params, 'train')}""" for f in (1, 2) for i, params in enumerate(_GRID))},
scored AS (
  {' UNION ALL '.join(f"SELECT {i} AS setting, {f} AS fold, {p.trees} AS trees, {p.depth} AS depth, CAST({p.step} AS DOUBLE) AS step, y, yhat FROM forest_{f}_{i} WHERE test"
                      for f in (1, 2) for i, p in enumerate(_GRID))})"""


def _tune_trees(spark, path):
    rows, last = materialize(_features(spark, path)), last_month(spark, path)
    folds = [fold_rows(rows, fold_origin(last, f, 2, 6, 6, 0, "month"), 6, 0, "month") for f in (1, 2)]
    return M.tune_gbt(folds, INPUTS, _GRID)


@query("tune_gbt", f"{_TUNED_TREES} SELECT setting, fold, trees, depth, step, {ERRORS} FROM scored GROUP BY ALL")
def tune_gbt(spark, path):
    return rounded(_tune_trees(spark, path), ERROR_PLACES)


@query("tuned_setting", f"""{_TUNED_TREES}
SELECT setting, trees, depth, step, round(avg(wape), 8) AS wape
FROM (SELECT setting, fold, trees, depth, step, sum(abs(yhat - y)) / sum(abs(y)) AS wape FROM scored GROUP BY ALL)
GROUP BY setting, trees, depth, step ORDER BY avg(wape), setting LIMIT 1""")
def tuned_setting(spark, path):
    return rounded(M.best_setting(_tune_trees(spark, path)), {"wape": 8})


@query("saved_model", f"SELECT *, CAST(0 AS DOUBLE) AS moved FROM ({_BOOSTED})")
def saved_model(spark, path):
    """Scores of a model that was stored and loaded again, and how far they moved: not at all."""
    rows, model = _boosted(spark, path)
    stored = new_path(spark, "model")
    M.save_model(model, stored)
    before = M.predict(model, rows).withColumnRenamed("yhat", "before")
    again = M.predict(M.load_model(stored), before)
    return rounded(again.select("nation_key", "ds", "y", "yhat", F.abs(F.col("yhat") - F.col("before")).alias("moved")), {"yhat": 2})


_DIRECT_NAMES = [*SPEC.past, "month", "horizon"]


def _direct_trees_sql(horizon: int, folds: dict[int, int]) -> str:
    """CTE ``direct``: forecasts of a model for all horizons, fitted up to each fold's origin (months before the end)."""
    rows = ",\n".join(f"""rows_{f} AS (
  SELECT *, ds <= last_ds - INTERVAL {behind} MONTH AND label IS NOT NULL AND y_lag_12 IS NOT NULL AS train,
    origin = last_ds - INTERVAL {behind} MONTH AS scored FROM cells, bounds),
{_forest_sql(f'forest_{f}', f'rows_{f}', _DIRECT_NAMES, [], 'label', SMALL, 'train')}""" for f, behind in folds.items())
    every = "\nUNION ALL ".join(f"SELECT nation_key, {f} AS fold, origin, ds, horizon, label, yhat, level FROM forest_{f} WHERE scored" for f in folds)
    return f"""{PANEL},
steps AS (SELECT CAST(unnest(range(1, {horizon + 1})) AS INTEGER) AS horizon),
starts AS (
  SELECT nation_key, ds, {', '.join(f'lag(y, {k - 1}) OVER o AS y_lag_{k}' for k in SPEC.lags)}, avg(y) OVER o AS level,
    {', '.join(f'avg(y) OVER (o ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS y_mean_{w}' for w in SPEC.means)}
  FROM panel WINDOW o AS (PARTITION BY nation_key ORDER BY ds)),
cells AS (
  SELECT o.* EXCLUDE (ds), o.ds AS origin, horizon, CAST(o.ds + to_months(horizon) AS DATE) AS ds,
    CAST(month(CAST(o.ds + to_months(horizon) AS DATE)) AS INTEGER) AS month, t.y AS label
  FROM starts o CROSS JOIN steps LEFT JOIN panel t ON t.nation_key = o.nation_key AND t.ds = CAST(o.ds + to_months(horizon) AS DATE)),
{rows},
direct AS (
  SELECT nation_key, CAST(fold AS INTEGER) AS fold, origin, ds, horizon, 'gbt_direct' AS model, label AS y, yhat, 'model' AS status,
    nullif(level, 0) AS level FROM ({every}))"""


@query("forecast_direct", f"""{_direct_trees_sql(12, {0: 0})}
SELECT nation_key, origin, ds, horizon, model, round(yhat, 2) AS yhat, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, status FROM direct""")
def forecast_direct(spark, path):
    last = last_month(spark, path)
    table = materialize(H.horizon_table(nation_panel(spark, path), K, 12, "month", SPEC, last))
    return rounded(H.forecast_direct(table, K, SPEC, last, SMALL)[0], {"yhat": 2})


@query("forecast_recursive")
def forecast_recursive(spark, path):
    """No SQL: it would have to walk ten trees twelve times over. Tests compare it with a loop over the steps."""
    panel = materialize(nation_panel(spark, path))
    model = H.fit_step(panel, K, SPEC, SMALL)
    return H.forecast_recursive(model, panel, K, 12, "month", SPEC, last_month(spark, path))


@query("backtest", f"""{_direct_trees_sql(6, {1: 12, 2: 6})},
folds AS (SELECT DISTINCT fold, origin FROM direct),
spots AS (SELECT nation_key, fold, origin, ds, horizon, y FROM direct),
fitted AS (
  SELECT nation_key, fold,
    CAST(sum(CASE WHEN ds > origin - INTERVAL 12 MONTH THEN CAST(y AS DECIMAL(38,4)) END) AS DOUBLE) / 12 AS mean_y,
    regr_slope(y, datediff('month', DATE '1970-01-01', ds)) AS slope,
    regr_intercept(y, datediff('month', DATE '1970-01-01', ds)) AS intercept
  FROM panel JOIN folds ON ds <= origin GROUP BY ALL),
lines AS (
  SELECT s.*, mean_y, intercept + slope * datediff('month', DATE '1970-01-01', s.ds) AS line, p.y AS before
  FROM spots s JOIN fitted f ON f.nation_key = s.nation_key AND f.fold = s.fold
  JOIN panel p ON p.nation_key = s.nation_key AND p.ds = s.ds - INTERVAL 12 MONTH)
SELECT nation_key, fold, origin, ds, horizon, model, y, round(yhat, 2) AS yhat, status FROM (
  SELECT nation_key, fold, origin, ds, horizon, model, y, yhat, status FROM direct
  UNION ALL SELECT nation_key, fold, origin, ds, horizon, 'seasonal_naive', y, before, 'baseline' FROM lines
  UNION ALL SELECT nation_key, fold, origin, ds, horizon, 'moving_average', y, mean_y, 'baseline' FROM lines
  UNION ALL SELECT nation_key, fold, origin, ds, horizon, 'linear_trend', y, line, 'baseline' FROM lines)""")
def backtest(spark, path):
    panel = materialize(nation_panel(spark, path))
    return rounded(run_backtest(panel, K, "month", n=2, horizon=6, step=6, params=SMALL, last=last_month(spark, path)), {"yhat": 2})


@query("forecast_revenue", f"""{_direct_trees_sql(6, {0: 0, 1: 12, 2: 6})},
limited AS (
  SELECT *, quantile_cont(CASE WHEN fold > 0 THEN (y - yhat) / level END, 0.1) OVER h AS q_lo,
    quantile_cont(CASE WHEN fold > 0 THEN (y - yhat) / level END, 0.9) OVER h AS q_hi
  FROM direct WINDOW h AS (PARTITION BY horizon))
SELECT nation_key, origin, ds, horizon, model, status, round(yhat, 2) AS yhat, round(greatest(yhat + q_lo * level, 0), 2) AS lo,
  round(greatest(yhat + q_hi * level, 0), 2) AS hi FROM limited WHERE fold = 0""")
def forecast_revenue(spark, path):
    out = run_forecast(nation_panel(spark, path), K, "month", 6, 2, SPEC, SMALL, last=last_month(spark, path))
    return rounded(out, {"yhat": 2, "lo": 2, "hi": 2})
