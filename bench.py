"""Times the headline jobs and prints one line of JSON.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores and
BENCH_REPEATS how often each job runs; the median run counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tillcast.catalog.base import nation_panel
from tillcast.models.gbt import GbtParams, Inputs, fit_gbt, param_grid, predict, tune_gbt
from tillcast.models.horizons import fit_step, forecast_direct, forecast_recursive, horizon_table
from tillcast.operators.evaluate import metrics
from tillcast.operators.features import FeatureSpec, drop_warmup
from tillcast.operators.panel import pareto, revenue_by_period
from tillcast.operators.splits import fold_origin, fold_rows, holdout
from tillcast.plans.backtest import backtest_baselines, backtest_gbt
from tillcast.plans.panels import period_bounds
from tillcast.session import build_session, materialize
from tillcast.sources.sales import load_sales, read_tables, sales_quality

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session("tillcast-bench", f"local[{CPUS}]", {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, job, repeats=REPEATS):
        """Median of some runs: the first also pays for compiling its code."""
        spent = []
        for _ in range(repeats):
            start = time.perf_counter()
            result = job()
            spent.append(time.perf_counter() - start)
        times[name] = round(median(spent), 3)
        return result

    spec = FeatureSpec()
    run(read_tables(spark, SF_DIR).nation)

    timed("sales_lines", lambda: run(load_sales(spark, SF_DIR)))
    timed("revenue_from_lines", lambda: run(revenue_by_period(
        load_sales(spark, SF_DIR), ["nation_key", "brand"], "month")))
    for name, keys, grain in [
        ("panel_nation_month", ["nation_key"], "month"),
        ("panel_nation_day", ["nation_key"], "day"),
        ("panel_nation_brand_day", ["nation_key", "brand"], "day"),
    ]:
        timed(name, lambda keys=keys, grain=grain: run(nation_panel(spark, SF_DIR, keys, grain)))
    timed("features_nation_brand_day", lambda: run(drop_warmup(
        spec.from_panel(nation_panel(spark, SF_DIR, ["nation_key", "brand"], "day"), ["nation_key", "brand"]),
        spec.names)))
    timed("pareto_nation_brand", lambda: run(pareto(
        nation_panel(spark, SF_DIR, ["nation_key", "brand"]), ["nation_key", "brand"])))
    timed("backtest_baselines", lambda: run(metrics(backtest_baselines(
        nation_panel(spark, SF_DIR, ["nation_key", "brand"]), ["nation_key", "brand"], "month", 3, 12, 1, 12, 12,
        period_bounds(read_tables(spark, SF_DIR), "month")[1]), ["model", "horizon"])))

    for grain in ("month", "day"):
        last = period_bounds(read_tables(spark, SF_DIR), grain)[1]
        rows = timed(f"prepare_{grain}", lambda: materialize(drop_warmup(
            spec.from_panel(nation_panel(spark, SF_DIR, ["nation_key"], grain), ["nation_key"]), spec.names)))
        train, test = holdout(rows, 12 if grain == "month" else 365, grain, last)
        inputs = Inputs(tuple(spec.names), ("nation_key",), "y", ("nation_key", "ds"))
        model = timed(f"fit_{grain}", lambda: fit_gbt(train, inputs, GbtParams(trees=20, depth=4)))
        timed(f"score_{grain}", lambda: run(metrics(predict(model, test))))

    panel = nation_panel(spark, SF_DIR)
    last = period_bounds(read_tables(spark, SF_DIR), "month")[1]

    def direct():
        table = materialize(horizon_table(panel, ["nation_key"], 12, "month", spec, last))
        run(forecast_direct(table, ["nation_key"], spec, last, GbtParams(trees=20, depth=4))[0])
    timed("forecast_direct", direct)

    small = GbtParams(trees=5, depth=3)
    timed("sales_quality", lambda: run(sales_quality(read_tables(spark, SF_DIR))))
    timed("panel_customer_month", lambda: run(nation_panel(spark, SF_DIR, ["customer_key"])))
    stored = materialize(panel)
    step_model = fit_step(stored, ["nation_key"], spec, small)
    for steps in (12, 60, 120):
        timed(f"forecast_recursive_{steps}", lambda: run(forecast_recursive(
            step_model, stored, ["nation_key"], steps, "month", spec, last)))
    timed("backtest_gbt", lambda: run(metrics(backtest_gbt(
        stored, ["nation_key"], "month", 3, 12, 1, spec, small, last), ["horizon"])), 1)
    rows = materialize(drop_warmup(spec.from_panel(stored, ["nation_key"]), spec.names))
    folds = [fold_rows(rows, fold_origin(last, f, 2, 6, 6, 0, "month"), 6, 0, "month") for f in (1, 2)]
    step = Inputs(tuple(spec.names), ("nation_key",), "y", ("nation_key", "ds"))
    timed("tune_4_settings", lambda: run(tune_gbt(folds, step, param_grid(small, depth=[2, 4], step=[0.1, 0.3]))), 1)

    print(json.dumps({
        "metric": "total wall time of the headline jobs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "repeats": REPEATS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
