"""Invariants of the boosted model and of the forecasts made with it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.models import gbt as M
from tillcast.models import horizons as H
from tillcast.models.trees import TreeTable
from tillcast.operators.evaluate import metrics
from tillcast.operators.features import FeatureSpec, drop_warmup
from tillcast.operators.splits import holdout
from tillcast.plans.backtest import backtest
from tillcast.plans.forecast import forecast_revenue
from tillcast.session import delete_stored, materialize, materialize_at

K = ["sid"]
SPEC = FeatureSpec()
SMALL = M.GbtParams(trees=5, depth=3)


@pytest.fixture(scope="module")
def planted(spark):
    """50 series of 72 months with a season and a jump on discounted months."""
    noise = 0.05 * (F.pmod(F.hash("id", F.lit(11)), F.lit(2001)) - 1000) / 1000
    rows = spark.range(3600).select(
        (F.col("id") / 72).cast("int").alias("sid"),
        F.add_months(F.lit(dt.date(2015, 1, 1)), (F.col("id") % 72).cast("int")).alias("ds"),
        (F.pmod(F.hash("id", F.lit(7)), F.lit(1000)) / 10000).alias("disc"), noise.alias("e"),
    )
    level = (1000 + 40 * F.col("sid")) * (1 + 0.3 * F.sin(2 * F.pi() * F.month("ds") / 12))
    return materialize(rows.select(
        "sid", "ds", "disc", (level * F.when(F.col("disc") > 0.06, 1.4).otherwise(1.0) * (1 + F.col("e"))).alias("y")))


@pytest.fixture(scope="module")
def rows(planted):
    return materialize(drop_warmup(SPEC.from_panel(planted, K), SPEC.names))


def inputs(*extra):
    return M.Inputs((*SPEC.names, *extra), ("sid",), "y", ("sid", "ds"))


def test_model_beats_the_baselines_on_planted_signal(rows):
    train, test = holdout(rows, 12, "month")
    scored = M.predict(M.fit_gbt(train, inputs("disc"), M.GbtParams(trees=15, step=0.3)), test)
    wape = {
        c: metrics(scored.select("y", F.col(c).alias("yhat"))).first().wape for c in ("yhat", "y_lag_12", "y_mean_12")}
    assert wape["yhat"] < 0.6 * min(wape["y_lag_12"], wape["y_mean_12"])


def test_refit_on_other_partitions_gives_the_same_model(rows):
    one = M.predict(M.fit_gbt(rows, inputs(), SMALL, tasks=4), rows)
    two = M.predict(M.fit_gbt(rows.repartition(7).orderBy("y"), inputs(), SMALL, tasks=4), rows)
    both = one.withColumnRenamed("yhat", "a").join(two.select(*K, "ds", "yhat"), [*K, "ds"])
    assert both.filter(F.abs(F.col("a") - F.col("yhat")) > 1e-6 * F.abs("a")).isEmpty()


def test_first_tree_splits_where_the_table_says(rows):
    best = M.split_gain(rows, "month").orderBy(F.desc("gain_share")).first()
    model = M.fit_gbt(rows, M.Inputs(("month",), (), "y", ("sid", "ds")), M.GbtParams(trees=1, depth=1))
    root = model.stages[-1].trees[0]._call_java("rootNode")
    assert root.split().threshold() == best.threshold + 0.5


def test_split_gain_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (3, 5.0), (4, 5.0), (None, 9.0)], "f int, y double")
    out = {r.threshold: (r.n_left, r.n_right, r.gain_share) for r in M.split_gain(df, "f").collect()}
    assert out[2] == (3, 2, pytest.approx(1.0)) and set(out) == {1, 2, 3}


def test_stored_model_scores_the_same(rows, tmp_path):
    model = M.fit_gbt(rows, inputs(), SMALL)
    M.save_model(model, str(tmp_path / "m"))
    again = M.predict(M.load_model(str(tmp_path / "m")), M.predict(model, rows).withColumnRenamed("yhat", "a"))
    assert again.filter(F.col("a") != F.col("yhat")).isEmpty()


def test_importance_names_the_inputs(rows, spark):
    out = M.feature_importance(M.fit_gbt(rows, inputs("disc"), SMALL), spark).collect()
    assert {r.feature for r in out} == {"sid_index", *SPEC.names, "disc"}
    assert sum(r.importance for r in out) == pytest.approx(1.0)
    assert [r.position for r in out] == list(range(1, len(out) + 1))


def test_early_stop_keeps_fewer_trees_without_signal(rows):
    noise = rows.withColumn("y", F.pmod(F.hash("sid", "ds"), F.lit(1000)).cast("double"))
    train, valid = holdout(noise, 12, "month")
    model = M.early_stop(train, valid, inputs(), M.GbtParams(trees=15, depth=5, step=0.5))
    assert 1 <= M.tree_count(model) < 15


def test_unseen_series_are_scored(rows, spark):
    model = M.fit_gbt(rows.filter("sid < 40"), inputs(), SMALL)
    assert M.predict(model, rows.filter("sid >= 40")).filter(F.col("yhat").isNull()).isEmpty()


def test_log_target_round_trip(spark):
    df = spark.createDataFrame([(0.0,), (12.5,), (3e9,)], "y double")
    assert [r.b for r in df.withColumn("l", M.log_target()).select(M.unlog("l").alias("b")).collect()] == pytest.approx(
        [0.0, 12.5, 3e9], rel=1e-9)


def test_grid_scores_every_setting_and_fold(rows):
    folds = [holdout(rows.filter(F.col("ds") < cut), 6, "month") for cut in ("2019-07-01", "2020-01-01")]
    scores = M.tune_gbt(folds, inputs(), M.param_grid(M.GbtParams(trees=2), depth=[1, 4]))
    assert {(r.setting, r.fold, r.n) for r in scores.collect()} == {(s, f, 300) for s in (0, 1) for f in (1, 2)}
    best = M.best_setting(scores).collect()
    assert len(best) == 1 and best[0].depth == 4


def test_settings_share_the_layout_of_a_fold(rows, monkeypatch):
    folds = [holdout(rows.filter(F.col("ds") < cut), 6, "month") for cut in ("2019-07-01", "2020-01-01")]
    laid, fitted, lay, fit = [], [], M.fixed_layout, M.fit_rows
    monkeypatch.setattr(M, "fixed_layout", lambda *a: laid.append(a) or lay(*a))
    monkeypatch.setattr(M, "fit_rows", lambda rows, params: fitted.append(params) or fit(rows, params))
    grid = M.param_grid(M.GbtParams(trees=4), depth=[1, 4], step=[0.001, 0.3])
    whole = {(r.setting, r.fold): r.wape for r in M.tune_gbt(folds, inputs(), grid).collect()}
    assert len(laid) == 2 and len(fitted) == 8 and len(whole) == 8
    laid.clear(), fitted.clear()
    kept = {(r.setting, r.fold): r.wape for r in M.tune_gbt(folds, inputs(), grid, first_trees=2).collect()}
    assert len(laid) == 2 and sorted(p.trees for p in fitted) == [2] * 8 + [4] * 4
    assert len(kept) == 4 and all(whole[k] == pytest.approx(v) for k, v in kept.items())
    best = M.best_setting(M.tune_gbt(folds, inputs(), grid)).first().setting
    assert best in {s for s, _ in kept}


def test_gaps_are_filled_with_training_means_and_marked(spark, rows, tmp_path):
    gap = (F.col("sid") % 3 == 0) & (F.month("ds") < 7)
    gappy = materialize(rows.withColumn("x", F.when(~gap, F.col("y"))).withColumn("z", F.when(gap, F.lit(float("nan"))).otherwise(F.col("y"))))
    known = M.Inputs(("x", "z", "month"), (), "y", ("sid", "ds"), imputed=("x", "z"))
    assert known.assembled == ["x_filled", "x_missing", "z_filled", "z_missing", "month"]
    train, test = holdout(gappy, 12, "month")
    model = M.fit_gbt(train, known, M.GbtParams(trees=8, depth=4))
    scored = M.predict(model, test.withColumn("x", F.lit(None).cast("double")))
    assert scored.count() == test.count() and scored.filter("yhat is null").isEmpty() and scored.columns == [*test.columns, "yhat"]
    mean = train.agg(F.avg("x")).first()[0]
    made = model.transform(test.limit(300)).collect()
    assert all((r.x_filled, r.x_missing, r.z_missing) == ((mean, 1.0, 1.0) if r.x is None else (r.x, 0.0, 0.0)) for r in made)
    M.save_model(model, str(tmp_path / "m"))
    assert [r.yhat for r in M.predict(M.load_model(str(tmp_path / "m")), test).collect()] == [r.yhat for r in M.predict(model, test).collect()]
    nothing = M.fit_gbt(train.withColumn("x", F.lit(None).cast("double")), known, M.GbtParams(trees=1, depth=2))
    assert M.predict(nothing, test).filter("yhat is null").isEmpty()


def test_direct_forecasts_are_whole_and_contiguous(planted):
    table = materialize(H.horizon_table(planted, K, 6, "month", SPEC))
    out, _ = H.forecast_direct(table, K, SPEC, F.lit(dt.date(2020, 12, 1)), SMALL)
    _whole(out, 6)


def test_recursive_forecasts_are_whole_and_contiguous(planted):
    out = H.forecast_recursive(H.fit_step(planted, K, SPEC, SMALL), planted, K, 6, "month", SPEC)
    _whole(out, 6)


def _whole(out, horizon):
    rows = out.collect()
    assert len(rows) == 50 * horizon and all(r.yhat is not None for r in rows)
    months = [dt.date(2021, m, 1) for m in range(1, horizon + 1)]
    by_series = {}
    for r in sorted(rows, key=lambda r: r.horizon):
        by_series.setdefault(r.sid, []).append(r.ds)
    assert all(dates == months for dates in by_series.values())


def test_first_recursive_step_equals_scoring_the_features(planted):
    """One step ahead, carrying history as an array changes nothing."""
    cut = dt.date(2020, 11, 1)
    past = planted.filter(F.col("ds") <= F.lit(cut))
    model = H.fit_step(past, K, SPEC, SMALL)
    step = H.forecast_recursive(model, past, K, 1, "month", SPEC)
    direct = M.predict(model, SPEC.from_panel(planted, K).filter(F.col("ds") == F.lit(dt.date(2020, 12, 1))))
    both = step.select("sid", F.col("yhat").alias("a")).join(direct.select("sid", "yhat"), "sid")
    assert both.count() == 50 and both.filter(F.abs(F.col("a") - F.col("yhat")) > 1e-6 * F.abs("a")).isEmpty()


def test_forecasts_do_not_see_the_future(planted):
    """What happens after the origin changes no forecast made at it."""
    origin = F.lit(dt.date(2019, 12, 1))
    changed = planted.withColumn("y", F.when(F.col("ds") > origin, F.col("y") * 100).otherwise(F.col("y")))
    found = []
    for panel in (planted, changed):
        table = materialize(H.horizon_table(panel, K, 4, "month", SPEC))
        direct, _ = H.forecast_direct(table, K, SPEC, origin, SMALL)
        past = panel.filter(F.col("ds") <= origin)
        recursive = H.forecast_recursive(H.fit_step(past, K, SPEC, SMALL), panel, K, 4, "month", SPEC, origin)
        found.append({(r.model, r.sid, r.horizon): r.yhat for r in direct.unionByName(recursive).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 2 * 50 * 4
    assert all(found[1][k] == pytest.approx(v, rel=1e-9) for k, v in found[0].items())


def test_backtest_has_all_models_on_the_same_cells(planted):
    out = backtest(planted, K, "month", n=2, horizon=3, step=3, params=SMALL)
    cells = {}
    for r in out.collect():
        cells.setdefault(r.model, set()).add((r.sid, r.fold, r.origin, r.ds, r.horizon, r.y))
    assert set(cells) == {"seasonal_naive", "moving_average", "linear_trend", "gbt_direct"}
    assert len({frozenset(c) for c in cells.values()}) == 1 and len(cells["gbt_direct"]) == 50 * 2 * 3


def test_forecast_job_gives_ordered_limits(planted):
    out = forecast_revenue(planted, K, "month", 3, 2, SPEC, SMALL)
    assert out.columns == ["sid", "origin", "ds", "horizon", "model", "yhat", "status", "lo", "hi"]
    rows = out.collect()
    assert len(rows) == 150 and all(0 <= r.lo <= r.hi for r in rows)


def test_limits_cover_small_and_large_series_alike(planted):
    sized = planted.withColumn("y", F.col("y") * F.when(F.col("sid") % 2 == 0, 1.0).otherwise(1000.0))
    past = sized.filter(F.col("ds") <= F.lit(dt.date(2019, 12, 1)))
    out = forecast_revenue(past, K, "month", 6, 4, SPEC, SMALL)
    both = out.join(sized.select("sid", "ds", "y"), ["sid", "ds"])
    share = {r.small: r.inside for r in both.groupBy((F.col("sid") % 2 == 0).alias("small")).agg(
        F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("inside")).collect()}
    assert all(0.5 < s < 1 for s in share.values())


def test_every_series_is_forecast(planted):
    """Series of 0, 1, 6 and 72 months; the short ones get the mean of what they have."""
    origin = dt.date(2020, 12, 1)
    months = {0: 0, 1: 1, 2: 6}
    kept = F.coalesce(F.create_map(*[F.lit(x) for p in months.items() for x in p])[F.col("sid")], F.lit(72))
    panel = materialize(planted.select("sid", "ds", "y").filter(
        (F.col("ds") > F.add_months(F.lit(origin), -kept)) | (F.col("sid") == 0) & (F.col("ds") == F.lit(origin))))
    cut = F.lit(dt.date(2020, 11, 1))
    table = materialize(H.horizon_table(panel, K, 3, "month", SPEC))
    direct, _ = H.forecast_direct(table, K, SPEC, cut, SMALL)
    model = H.fit_step(planted.filter(F.col("ds") <= cut), K, SPEC, SMALL)
    recursive = H.forecast_recursive(model, panel, K, 3, "month", SPEC, cut)
    means = {r.sid: r.m for r in panel.filter(F.col("ds") <= cut).groupBy("sid").agg(F.avg("y").alias("m")).collect()}
    for out in (direct, recursive):
        rows = {(r.sid, r.horizon): r for r in out.collect()}
        assert rows.keys() == {(s, h) for s in range(50) for h in (1, 2, 3)}
        assert {rows[0, h].status for h in (1, 2, 3)} == {"no past"} and rows[0, 1].yhat is None
        assert rows[2, 2].status == "mean of past" and rows[2, 2].yhat == pytest.approx(means[2])
        assert all(rows[s, 3].status == "model" for s in range(3, 50))


def step_by_step(model, panel, origin, steps):
    """Recursive forecasts as a plain loop: score the next month from the panel, add it, go on."""
    known, out = panel.filter(F.col("ds") <= F.lit(origin)).select("sid", "ds", "y"), {}
    for h in range(1, steps + 1):
        ds = F.add_months(F.lit(origin), h)
        empty = known.select("sid").distinct().select("sid", ds.alias("ds"), F.lit(None).cast("double").alias("y"))
        row = SPEC.from_panel(known.unionByName(empty), K).filter(F.col("ds") == ds)
        new = materialize(M.predict(model, row).select("sid", "ds", F.col("yhat").alias("y")))
        out |= {(r.sid, h): r.y for r in new.collect()}
        known = known.unionByName(new)
    return out


@pytest.mark.parametrize("categories", [(), ("sid",)])
def test_recursion_in_one_expression_equals_a_loop(planted, categories):
    origin = dt.date(2020, 6, 1)
    model = H.fit_step(planted, K, SPEC, M.GbtParams(trees=6, depth=4), categories=categories)
    got = {(r.sid, r.horizon): r.yhat for r in H.forecast_recursive(model, planted, K, 5, "month", SPEC, F.lit(origin)).collect()}
    assert len(got) == 250 and got == pytest.approx(step_by_step(model, planted, origin, 5), rel=1e-9)


def test_recursion_is_one_shuffle_for_any_horizon(planted):
    model = H.fit_step(planted, K, SPEC, SMALL)
    plans = [H.forecast_recursive(model, planted, K, n, "month", SPEC, F.lit(dt.date(2020, 12, 1)))._jdf.queryExecution() for n in (8, 120)]
    sizes = [len(p.optimizedPlan().toString()) for p in plans]
    assert abs(sizes[0] - sizes[1]) < 100 and plans[1].executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "from_json" not in plans[1].optimizedPlan().toString()


@pytest.mark.parametrize("params", [M.GbtParams(trees=1, depth=1), M.GbtParams(trees=4, depth=5, loss="absolute"), M.GbtParams(trees=3, depth=2)])
def test_walked_trees_score_as_the_model_does(rows, params):
    model = M.fit_gbt(rows, inputs(), params)
    scored = model.transform(rows)
    x = F.array(*[F.col(c).cast("double") for c in model.stages[-2].getInputCols()])
    pairs = scored.select("yhat", TreeTable.of(model).predict(x).alias("walked")).collect()
    assert [r.walked for r in pairs] == pytest.approx([r.yhat for r in pairs], rel=1e-12)


def test_a_constant_model_is_a_leaf(rows):
    flat = materialize(rows.withColumn("y", F.lit(3.5)))
    table = TreeTable.of(M.fit_gbt(flat, inputs(), M.GbtParams(trees=2, depth=3)))
    assert table.depth == 0 and rows.limit(1).select(table.predict(F.array(F.lit(0.0))).alias("v")).first().v == pytest.approx(3.5)


SHORT = FeatureSpec(lags=(1, 12), means=(3,), calendar=("month",))


@pytest.mark.parametrize("months", [0, 1, 2, 12, 13, 14, 24, 36])
def test_any_history_gives_whole_forecasts(planted, months):
    """The forecasting job on the first months of the panel; nothing of it may fail or be left out."""
    last = dt.date(2015 + (months - 1) // 12, (months - 1) % 12 + 1, 1)
    panel = materialize(planted.select("sid", "ds", "y").filter(F.col("ds") <= F.lit(last) if months else F.lit(False)))
    y = {(r.sid, r.ds): r.y for r in panel.collect()}
    means = {s: sum(v for (k, _), v in y.items() if k == s) / months for s in range(50)} if months else {}
    out = forecast_revenue(panel, K, "month", 14, 2, SHORT, M.GbtParams(trees=2, depth=2))
    model = H.fit_step(panel, K, SHORT, M.GbtParams(trees=2, depth=2))
    again = H.forecast_recursive(model, panel, K, 14, "month", SHORT)
    assert (model is None) == (months < 13)
    for df in (out, again):
        found = {(r.sid, r.horizon): r for r in df.collect()}
        assert found.keys() == ({(s, h) for s in range(50) for h in range(1, 15)} if months else set())
        for (sid, h), r in found.items():
            ahead = months + h - 1
            assert r.ds == dt.date(2015 + ahead // 12, ahead % 12 + 1, 1) and r.origin == last
            before = ahead - 12 * -(-h // 12)
            if months >= 13:
                assert r.status == "model" and r.yhat > 0
            elif before >= 0:
                assert r.status == "seasonal value" and r.yhat == y[sid, dt.date(2015 + before // 12, before % 12 + 1, 1)]
            else:
                assert r.status == "mean of past" and r.yhat == pytest.approx(means[sid])


def test_backtest_goes_on_where_a_fold_has_nothing_to_train_on(planted):
    past = planted.filter(F.col("ds") < F.lit(dt.date(2016, 4, 1)))
    out = backtest(past, K, "month", n=3, horizon=3, step=3, params=SMALL, spec=SHORT).filter("model = 'gbt_direct'")
    seen = {(r.fold, r.status): r.n for r in out.groupBy("fold", "status").agg(F.count("*").alias("n")).collect()}
    assert seen == {(1, "mean of past"): 150, (2, "mean of past"): 150, (3, "seasonal value"): 150}
    with pytest.raises(ValueError, match="no training rows"):
        M.fit_gbt(past.limit(0).withColumn("x", F.lit(1.0)), M.Inputs(("x",), ("sid",), "y", ("sid", "ds")), SMALL)


def test_stored_tables_are_deleted_only_in_the_shared_folder(spark, tmp_path):
    df, path = materialize_at(spark.range(3))
    assert df.count() == 3
    delete_stored(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        delete_stored(spark, str(tmp_path))


def test_training_rows_take_more_pieces_as_they_grow(spark, monkeypatch):
    """A fit's tasks hold a bounded number of rows: more rows are laid out in more pieces, few in the least."""
    monkeypatch.setattr(M, "PIECE_ROWS", 10)
    rows = spark.range(100).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    inputs = M.Inputs(("x",), identity=("x", "y"))
    many = M.lay_out(rows, inputs, tasks=2)
    few = M.lay_out(rows.limit(15), inputs, tasks=2)
    try:
        assert many.rows.rdd.getNumPartitions() == 10
        assert many.rows.count() == 100
        assert few.rows.rdd.getNumPartitions() == 2
    finally:
        many.release()
        few.release()
