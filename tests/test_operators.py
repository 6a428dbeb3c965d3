"""Edge cases, brute-force comparisons and plan shapes of the operators."""

import bisect
import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.functions.measures import sum_units
from tillcast.functions.periods import complete_bounds, period_range, periods_between, shift
from tillcast.operators import baselines as B
from tillcast.operators import evaluate as E
from tillcast.operators import features as X
from tillcast.operators import intervals as I
from tillcast.operators import panel as P
from tillcast.operators import reconcile as R
from tillcast.operators import splits as S
from tillcast.operators.joins import attach
from tillcast.operators.running import pooled_quantiles, running_totals
from tillcast.plans.panels import dense_panel, period_bounds
from tillcast.session import materialize
from tillcast.sources import forecasts as store
from tillcast.sources.forecasts import drop_replaced, read_forecasts, write_forecasts
from tillcast.sources.sales import LINKS, load_sales, read_tables, sales_quality

K = ["k"]


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows, schema="k string, ds date, y double"):
    return spark.createDataFrame([(k, day(d), *rest) for k, d, *rest in rows], schema)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def monthly(spark, values, key="a", start="2020-01-01"):
    first = day(start)
    return [(key, f"{first.year + (first.month - 1 + i) // 12}-{(first.month - 1 + i) % 12 + 1:02d}-01", float(v))
            for i, v in enumerate(values)]


# ---- periods and panels

def test_period_arithmetic(spark):
    row = spark.range(1).select(
        shift(F.lit(day("2024-01-01")), -1, "month").alias("m"),
        shift(F.lit(day("2024-02-28")), 1, "day").alias("d"),
        shift(F.lit(day("2024-02-26")), 1, "week").alias("w"),
        periods_between(F.lit(day("2023-11-01")), F.lit(day("2024-03-01")), "month").alias("n"),
        periods_between(F.lit(day("2024-02-26")), F.lit(day("2024-03-11")), "week").alias("nw"),
        F.size(period_range(F.lit(day("2024-02-27")), F.lit(day("2024-03-01")), "day")).alias("leap"),
    ).first()
    assert (row.m, row.d, row.w) == (day("2023-12-01"), day("2024-02-29"), day("2024-03-04"))
    assert (row.n, row.nw, row.leap) == (4, 2, 4)


def test_unknown_grain_is_refused():
    with pytest.raises(ValueError, match="grain"):
        shift(F, 1, "year")


def test_complete_bounds_drop_partial_ends(spark):
    df = series(spark, [("a", "2020-01-15", 1.0), ("a", "2020-03-30", 1.0)])
    first, last = complete_bounds(df, "ds", "month")
    assert spark.range(1).select(first, last).first()[:] == (day("2020-02-01"), day("2020-02-01"))
    whole = series(spark, [("a", "2020-01-01", 1.0), ("a", "2020-03-31", 1.0)])
    first, last = complete_bounds(whole, "ds", "month")
    assert spark.range(1).select(first, last).first()[:] == (day("2020-01-01"), day("2020-03-01"))


def test_densify_fills_gaps_ends_and_null_keys(spark):
    df = series(spark, [
        ("a", "2020-01-01", 5.0), ("a", "2020-04-01", 7.0), ("b", "2020-02-01", 3.0), (None, "2020-03-01", 1.0)])
    rows = {(r.k, r.ds.month): r.y for r in P.densify(df, K, "month").collect()}
    assert len(rows) == 12
    assert {key: y for key, y in rows.items() if y} == {
        ("a", 1): 5.0, ("a", 4): 7.0, ("b", 2): 3.0, (None, 3): 1.0}


def test_densify_leaves_out_rows_beyond_the_bounds(spark):
    df = series(spark, [("a", "2019-12-01", 5.0), ("a", "2020-02-01", 1.0), ("a", "2020-05-01", 7.0)])
    got = [(r.ds.month, r.y) for r in P.densify(df, K, "month", (F.lit(day("2020-01-01")), F.lit(day("2020-03-01")))).orderBy("ds").collect()]
    assert got == [(1, 0.0), (2, 1.0), (3, 0.0)]


def test_densify_over_leap_day(spark):
    df = series(spark, [("a", "2024-02-28", 1.0), ("a", "2024-03-01", 2.0)])
    assert [(r.ds.isoformat(), r.y) for r in P.densify(df, K, "day").orderBy("ds").collect()] == [
        ("2024-02-28", 1.0), ("2024-02-29", 0.0), ("2024-03-01", 2.0)]


@pytest.mark.parametrize("keys,grain", [(["nation_key"], "month"), (["region_key", "brand"], "week"),
                                        (["customer_key", "segment"], "day"), ([], "month")])
@pytest.mark.parametrize("exclude_returns", [False, True])
def test_panel_from_orders_equals_panel_from_lines(spark, small, keys, grain, exclude_returns):
    tables = read_tables(spark, small)
    fast = P.revenue_panel(tables, keys, grain, exclude_returns)
    slow = P.revenue_by_period(load_sales(spark, small, exclude_returns), keys, grain)
    assert fast.columns == slow.columns and fast.dtypes == slow.dtypes
    assert fast.exceptAll(slow).isEmpty() and slow.exceptAll(fast).isEmpty()


def test_panel_accepts_decimal_prices(spark, small):
    tables = read_tables(spark, small)
    exact = tables.lineitem.withColumns({
        c: F.col(c).cast("decimal(15,2)") for c in ("l_quantity", "l_extendedprice", "l_discount")})
    other = type(tables)(exact, *[getattr(tables, n) for n in list(tables.__dataclass_fields__)[1:]])
    a, b = (P.revenue_panel(t, ["nation_key"], "month") for t in (tables, other))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_unit_sums_are_exact_for_any_sign_and_size(spark):
    values = [0, 1, -1, 2**20, -(2**20) - 1, 10**17 + 3, -(10**17), 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert int(df.agg(sum_units(F.col("v"))).first()[0]) == sum(values)


def test_one_hot_order_customer_and_part(spark, small):
    """A third of the lines on one order, part and customer changes no total."""
    tables = read_tables(spark, small)
    hot = F.col("l_linenumber") % 3 == 0
    lines = tables.lineitem.withColumns({
        "l_orderkey": F.when(hot, F.lit(1)).otherwise(F.col("l_orderkey")),
        "l_partkey": F.when(hot, F.lit(1)).otherwise(F.col("l_partkey")),
    })
    other = type(tables)(lines, *[getattr(tables, n) for n in list(tables.__dataclass_fields__)[1:]])
    panel = P.revenue_panel(other, ["nation_key", "brand"], "month")
    want = lines.join(tables.orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(
        F.sum(F.col("l_quantity")).alias("q"), F.count_distinct("l_orderkey").alias("n")).first()
    got = panel.agg(F.sum("units").alias("q")).first()
    assert got.q == want.q
    assert P.revenue_panel(other, [], "month").agg(F.sum("n_orders")).first()[0] == want.n


def test_missing_dimension_rows_keep_their_sales(spark, small):
    tables = read_tables(spark, small)
    fields = {n: getattr(tables, n) for n in tables.__dataclass_fields__}
    fields["customer"] = tables.customer.filter("c_custkey % 2 = 0")
    cut = type(tables)(**fields)
    whole = P.revenue_panel(tables, [], "month").agg(F.sum("units")).first()[0]
    assert P.revenue_panel(cut, ["nation_key"], "month").agg(F.sum("units")).first()[0] == whole


def test_unknown_series_key(spark, small):
    with pytest.raises(ValueError, match="store"):
        P.revenue_panel(read_tables(spark, small), ["store"], "month")


def test_pareto_against_brute_force(spark, pieces):
    rng = random.Random(5)
    values = [round(rng.choice([0, 1, 5, 5, 250]) * rng.random(), 4) if i % 7 else 5.0 for i in range(400)]
    df = spark.createDataFrame([(i, day("2020-01-01"), v) for i, v in enumerate(values)], "k int, ds date, y double")
    got = {r.k: (r.position, r.abc) for r in P.pareto(df.repartition(5), K).collect()}
    total, upto = sum(round(v * 10000) for v in values), 0
    for place, (v, k) in enumerate(sorted((-round(v * 10000), k) for k, v in enumerate(values)), 1):
        share = upto / total
        assert got[k] == (place, "A" if share < 0.8 else "B" if share < 0.95 else "C")
        upto -= v


def test_pareto_without_any_revenue(spark):
    df = series(spark, [("a", "2020-01-01", 0.0), ("b", "2020-01-01", 0.0)])
    assert [(r.k, r.cum_share, r.abc) for r in P.pareto(df, K).orderBy("k").collect()] == [
        ("a", None, "C"), ("b", None, "C")]


def test_top_series_breaks_ties_by_key(spark):
    df = series(spark, [("b", "2020-01-01", 2.0), ("a", "2020-01-01", 2.0), ("c", "2020-01-01", 1.0)])
    assert [(r.k, r.position) for r in P.top_series(df, K, 2).orderBy("position").collect()] == [("a", 1), ("b", 2)]


def test_top_series_of_one_hot_parent(spark, pieces):
    """Nearly all series in one parent, null parents too: the best of pieces, then the best of these."""
    rng = random.Random(12)
    rows = [("hot" if i % 10 else rng.choice(["cold", None]), f"s{i}", float(rng.randint(0, 40))) for i in range(700)]
    df = spark.createDataFrame(rows, "p string, k string, y double")
    for n in (1, 7, 1500):
        out = P.top_series(df, ["p", "k"], n, "p")
        want = set()
        for parent in ("hot", "cold", None):
            ranked = sorted(((-y, k) for q, k, y in rows if q == parent))[:n]
            want |= {(parent, k, -y, i + 1) for i, (y, k) in enumerate(ranked)}
        assert {tuple(r) for r in out.collect()} == want
    # no step orders a parent before pieces of it have been cut to n rows
    text = plan(P.top_series(df, ["p", "k"], 1500, "p"))
    assert text.count("Window [row_number()") == 2 and "hashpartitioning(p" in text and "_piece" in text


def test_demand_classes(spark):
    rows = monthly(spark, [5, 5, 5, 5], "steady") + monthly(spark, [0, 0, 0, 0], "none") + monthly(
        spark, [9, 0, 0, 9], "sparse") + monthly(spark, [1, 100, 1, 1], "wild") + monthly(spark, [1, 0, 0, 100], "both")
    got = {r.k: r.demand_class for r in P.demand_profile(series(spark, rows), K).collect()}
    assert got == {"steady": "smooth", "none": "none", "sparse": "intermittent", "wild": "erratic", "both": "lumpy"}


def test_winsorize_ignores_rows_after_training(spark):
    rows = monthly(spark, [1, 2, 3, 4, 1000])
    out = P.winsorize(series(spark, rows), K, 0.0, 1.0, F.lit(day("2020-04-01"))).orderBy("ds").collect()
    assert [r.y_clipped for r in out] == [1, 2, 3, 4, 4] and [r.clipped for r in out] == [False] * 4 + [True]


# ---- running totals and quantiles

def test_running_totals_in_groups(spark, pieces):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 4 + ["b", "c", None]), i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    out = running_totals(df, ["i"], {"upto": F.col("v").cast("long"), "n": F.lit(1).cast("long")}, ["g"])
    want, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        total, n = seen.get(g, (0, 0))
        seen[g] = want[i] = (total + v, n + 1)
    got = {r.i: r for r in out.collect()}
    assert {i: (r.upto, r.n) for i, r in got.items()} == want
    assert all((r.upto_total, r.n_total) == seen[r.g] for r in got.values())


def test_running_totals_use_several_tasks(spark, pieces):
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("v"))
    stored = materialize(df.orderBy("i").withColumn("piece", F.spark_partition_id()))
    assert stored.select("piece").distinct().count() > 1
    out = running_totals(df, ["i"], {"n": F.col("v")})
    assert out.filter(F.col("n") != F.col("i") + 1).isEmpty()


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_pooled_quantiles(spark, pieces, p):
    rng = random.Random(11)
    groups = {"hot": 500, "b": 7, "one": 1}
    rows = [(g, rng.choice([0.0, 1.5, rng.uniform(-9, 9)])) for g, n in groups.items() for _ in range(n)] + [("b", None)]
    got = {r.g: r.q for r in pooled_quantiles(
        spark.createDataFrame(rows, "g string, x double"), "x", {"q": p}, ["g"]).collect()}
    for g in groups:
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], p), abs=1e-12)
    whole = pooled_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", {"q": p}).first().q
    assert whole == pytest.approx(np.quantile([x for _, x in rows if x is not None], p), abs=1e-12)


def test_attach_matches_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([(None, 9), ("z", 8)], "k string, y int")
    assert {(r.k, r.x, r.y) for r in attach(left, right, K, "left").collect()} == {("a", 1, None), (None, 2, 9)}
    assert {(r.k, r.x, r.y) for r in attach(left, right, K, "full").collect()} == {
        ("a", 1, None), (None, 2, 9), ("z", None, 8)}


# ---- features

def test_features_do_not_see_the_future(spark):
    """Multiplying everything after the origin leaves features up to t+1 alone."""
    rng = random.Random(2)
    origin = F.lit(day("2022-06-01"))
    rows = monthly(spark, [rng.uniform(1, 50) for _ in range(40)]) + monthly(
        spark, [rng.uniform(1, 50) for _ in range(40)], "b")
    own = ["y", "units", "n_orders", "avg_discount"]

    def features(factor):
        after = F.when(F.col("ds") > origin, factor).otherwise(1.0)
        df = series(spark, rows).select(
            "k", "ds", (F.col("y") * after).alias("y"), (F.col("y") / 2 * after).alias("units"),
            after.cast("bigint").alias("n_orders"), (after / 10).alias("avg_discount"), F.lit("x").alias("all"))
        df = X.lags(df, K, "y", [1, 2, 12])
        df = X.rolling(df, K, "y", 3, ["mean", "std", "min", "max", "sum"])
        df = X.expanding(df, K, "y")
        df = X.ewma(df, K, "y", 0.3, 4)
        df = X.growth(df, K, "y", 12)
        df = X.driver_lags(df, K, own[1:], [1, 2])
        df = X.target_encode_past(df, "all")
        df = X.seasonal_index(df, K, origin)
        known = df.filter(F.col("ds") <= F.add_months(origin, 1)).drop(*own)
        return sorted(map(str, known.collect()))

    assert features(1.0) == features(100.0)


def test_rolling_minimum_periods(spark):
    df = series(spark, monthly(spark, [1, 2, 3, 4]))
    full = [r.y_mean_3 for r in X.rolling(df, K, "y", 3).orderBy("ds").collect()]
    early = [r.y_mean_3 for r in X.rolling(df, K, "y", 3, min_periods=1).orderBy("ds").collect()]
    assert full == [None, None, None, 2.0] and early == [None, 1.0, 1.5, 2.0]


def test_growth_on_zero_base_is_null(spark):
    df = series(spark, monthly(spark, [0, 4, 8]))
    assert [r.y_growth_1 for r in X.growth(df, K, "y", 1).orderBy("ds").collect()] == [None, None, None]


def test_past_mean_leaves_out_peers_of_the_period(spark):
    rows = [("a", "2020-01-01", 10.0), ("b", "2020-01-01", 20.0), ("a", "2020-02-01", 1.0), ("b", "2020-02-01", 2.0)]
    df = series(spark, rows).withColumn("c", F.lit("x"))
    got = {(r.k, r.ds.month): r.c_past_mean for r in X.target_encode_past(df, "c").collect()}
    assert got == {("a", 1): None, ("b", 1): None, ("a", 2): 15.0, ("b", 2): 15.0}


def test_horizon_rows_of_a_single_row_series(spark):
    df = series(spark, [("a", "2020-01-01", 5.0)])
    rows = X.horizon_labels(df, K, 2, "month").orderBy("horizon").collect()
    assert [(r.origin, r.ds, r.label) for r in rows] == [
        (day("2019-12-01"), day("2020-01-01"), 5.0), (day("2019-12-01"), day("2020-02-01"), None)]


def test_horizon_rows_drop_unknown_measures(spark, small):
    panel = dense_panel(read_tables(spark, small), ["nation_key"], "month")
    assert not {"y", "units", "n_orders", "avg_discount"} & set(
        X.horizon_labels(panel, ["nation_key"], 2, "month").columns)


def test_history_features_equal_panel_features(spark):
    rng = random.Random(9)
    spec = X.FeatureSpec(lags=(1, 3, 12), means=(3, 12), calendar=("month", "quarter"))
    values = [rng.uniform(0, 1e6) for _ in range(13)]
    df = series(spark, monthly(spark, values))
    a = spec.from_panel(df, K).orderBy(F.desc("ds")).select(*spec.names).first()
    past = spark.createDataFrame([(day("2021-01-01"), values[:12])], "ds date, history array<double>")
    b = past.select(*[c.alias(n) for n, c in spec.from_history(F.col("history"), F.col("ds")).items()]).select(*spec.names).first()
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


def test_any_number_of_named_categories_is_indexed(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("c"))
    assert X.index_keys(df, ["c"]).agg(F.count_distinct("c_index")).first()[0] == 5000


def test_index_gives_unseen_and_null_keys_the_spare_value(spark):
    index = X.fit_key_index(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    rows = index.transform(spark.createDataFrame([("a",), ("zz",), (None,)], "c string")).collect()
    assert [r.c_index for r in rows] == [0.0, 2.0, 2.0]


# ---- splits and baselines

def test_folds_against_brute_force(spark):
    df = series(spark, monthly(spark, range(24)))
    out = S.rolling_origin(df, 3, 4, step=2, gap=1).collect()
    got = {(r.fold, r.role, int(r.y)) for r in out}
    want = set()
    for fold in (1, 2, 3):
        origin = 23 - 4 - 1 - (3 - fold) * 2
        want |= {(fold, "train", i) for i in range(origin + 1)}
        want |= {(fold, "test", i) for i in range(origin + 2, origin + 6)}
    assert got == want
    for fold in (1, 2, 3):
        origin = S.fold_origin(S.last_period(df), fold, 3, 4, 2, 1, "month")
        train, test = S.fold_rows(df, origin, 4, 1, "month")
        assert {(fold, "train", int(r.y)) for r in train.collect()} | {
            (fold, "test", int(r.y)) for r in test.collect()} == {w for w in want if w[0] == fold}


def test_baselines_against_brute_force(spark):
    rng = random.Random(4)
    values = [rng.uniform(0, 100) for _ in range(30)]
    rows = B.baseline_forecasts(series(spark, monthly(spark, values)), K, 15, "month", 12, 6).collect()
    months = [day(d) for _, d, _ in monthly(spark, range(60))]
    for r in rows:
        t, h = bisect.bisect_left(months, r.origin), r.horizon
        if r.origin < months[0] or t < 12:
            continue
        assert r.ds == months[t + h]
        assert r.y == (values[t + h] if t + h < 30 else None)
        if r.model == "seasonal_naive":
            want = values[t + 1 + (h - 1) % 12 - 12]
        elif r.model == "moving_average":
            want = statistics.fmean(values[t - 5:t + 1])
        else:
            slope, level = np.polyfit(range(t + 1), values[:t + 1], 1)
            want = level + slope * (t + h)
        assert r.yhat == pytest.approx(want, rel=1e-9)
    assert {r.model for r in rows} == set(B.BASELINES)


# ---- evaluation

def scores(spark, rows):
    return series(spark, rows, "k string, ds date, y double, yhat double")


def test_metrics_of_zero_series_are_null(spark):
    row = E.metrics(scores(spark, [("a", "2020-01-01", 0.0, 0.0), ("a", "2020-02-01", 0.0, 0.0)])).first()
    assert (row.n, row.mae, row.wape, row.mape, row.smape) == (2, 0.0, None, None, None)


def test_metrics_skip_rows_without_a_value(spark):
    row = E.metrics(scores(spark, [("a", "2020-01-01", 10.0, None), ("a", "2020-02-01", 10.0, 8.0)])).first()
    assert (row.n, row.mae, row.wape, row.bias) == (1, 2.0, 0.2, -2.0)


def test_leaderboard_keeps_series_without_a_score(spark):
    df = spark.createDataFrame(
        [("a", "m1", 0.5), ("a", "m2", 0.5), ("b", "m1", None), ("b", "m2", None), ("c", "m1", None), ("c", "m2", 1.0)],
        "k string, model string, wape double")
    assert {(r.k, r.model, r.wape) for r in E.leaderboard(df, K).collect()} == {
        ("a", "m1", 0.5), ("b", "m1", None), ("c", "m2", 1.0)}


def test_mase_of_flat_and_short_series(spark):
    train = series(spark, monthly(spark, [4] * 5, "flat") + monthly(spark, [1], "short") + monthly(
        spark, [1, 2, 4], "b"))
    df = scores(spark, [(k, "2021-01-01", 3.0, 5.0) for k in ("flat", "short", "b", "new")])
    assert {r.k: r.mase for r in E.mase(df, train, K, 1).collect()} == {
        "flat": None, "short": None, "b": pytest.approx(2 / 1.5), "new": None}


def test_pooled_and_direct_intervals_agree(spark, pieces):
    rng = random.Random(8)
    df = scores(spark, [(rng.choice("aab"), "2020-01-01", rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(300)])
    one = {r.k: (r.q_lo, r.q_hi) for r in I.residual_interval(df, K).collect()}
    two = {r.k: (r.q_lo, r.q_hi) for r in I.residual_interval(df, K, pooled=True).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)
    assert all(lo <= hi for lo, hi in one.values())


# ---- reconciliation and storage

def test_parents_equal_the_sum_of_their_children(spark, small):
    panel = dense_panel(read_tables(spark, small), ["region_key", "nation_key"], "month")
    fc = panel.select("region_key", "nation_key", "ds", F.col("ds").alias("origin"), F.lit(1).alias("horizon"),
                      F.lit("m").alias("model"), F.col("y").alias("yhat"))
    out = R.bottom_up(fc)
    sums = {r.level: r.s for r in out.groupBy("level").agg(F.sum("yhat").alias("s")).collect()}
    assert sums["total"] == pytest.approx(sums["region_key"]) == pytest.approx(sums["nation_key"])


def test_top_down_keeps_the_parent_total(spark):
    parents = spark.createDataFrame([(1, 100.0), (2, 50.0), (None, 8.0)], "region_key int, yhat double")
    train = spark.createDataFrame(
        [(1, 10, 3.0), (1, 11, 1.0), (2, 20, 0.0), (2, 21, 0.0), (None, 30, 5.0)],
        "region_key int, nation_key int, y double")
    got = {r.nation_key: r.yhat for r in R.top_down(parents, train).collect()}
    assert got == {10: 75.0, 11: 25.0, 20: 25.0, 21: 25.0, 30: 8.0}


def test_top_down_keeps_parents_without_training_rows(spark):
    parents = spark.createDataFrame([(1, 100.0), (7, 40.0)], "region_key int, yhat double")
    train = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.0)], "region_key int, nation_key int, y double")
    rows = R.top_down(parents, train).collect()
    assert sum(r.yhat for r in rows) == 140.0
    assert [(r.nation_key, r.share, r.yhat) for r in rows if r.region_key == 7] == [(None, 1.0, 40.0)]


def test_residual_acf_does_not_depend_on_row_order(spark):
    values = [(m, f, day(f"2020-{d:02d}-01"), float((d * 7 + f * 3 + len(m)) % 11), 1.0)
              for m in ("a", "bb") for f in (1, 2) for d in range(1, 13)]
    df = spark.createDataFrame([("k", *v) for v in values], "k string, model string, fold int, ds date, y double, yhat double")
    apart = {(r.model, r.fold): r.acf_1 for r in E.residual_acf(df, K, [1], ["model", "fold"]).collect()}
    again = {(r.model, r.fold): r.acf_1 for r in E.residual_acf(df.orderBy("y").repartition(5), K, [1], ["model", "fold"]).collect()}
    assert len(apart) == 4 and again == pytest.approx(apart)
    mixed = [E.residual_acf(d, K, [1]).first().acf_1 for d in (df, df.orderBy(F.desc("y")).repartition(3))]
    assert mixed[0] == pytest.approx(mixed[1])


def test_limits_follow_the_level_and_stay_above_the_least(spark):
    fc = spark.createDataFrame([("a", 10.0, 10.0), ("b", 1000.0, 1000.0), ("c", 1.0, None)], "k string, yhat double, level double")
    q = spark.createDataFrame([(1, -2.0, 0.5)], "g int, q_lo double, q_hi double")
    rows = I.with_interval(fc.withColumn("g", F.lit(1)), q, ["g"], F.col("level"), F.lit(0.0)).orderBy("k").collect()
    assert [(r.lo, r.hi) for r in rows] == [(0.0, 15.0), (0.0, 1500.0), (None, None)]


def test_actual_vs_forecast_keeps_both_sides(spark):
    actual = series(spark, [("a", "2020-01-01", 1.0), ("a", "2020-02-01", 9.0)])
    fc = spark.createDataFrame([("a", day("2020-02-01"), 5.0, 4.0, 6.0), ("a", day("2020-03-01"), 5.0, None, None)],
                               "k string, ds date, yhat double, lo double, hi double")
    got = [(r.ds.month, r.status, r.variance, r.outside) for r in
           R.actual_vs_forecast(actual, fc, K).orderBy("ds").collect()]
    assert got == [(1, "actual only", None, None), (2, "both", 4.0, True), (3, "forecast only", None, None)]


def test_future_frame_after_each_series_or_one_date(spark):
    df = series(spark, [("a", "2020-01-01", 1.0), ("b", "2020-03-01", 1.0)])
    own = {(r.k, r.ds.month) for r in R.future_frame(df, K, 2, "month").collect()}
    same = {(r.k, r.ds.month) for r in R.future_frame(df, K, 1, "month", F.lit(day("2020-05-01"))).collect()}
    assert own == {("a", 2), ("a", 3), ("b", 4), ("b", 5)} and same == {("a", 6), ("b", 6)}


def test_rewriting_a_run_leaves_other_runs(spark, tmp_path):
    path = str(tmp_path / "fc")
    df = spark.createDataFrame([(1, 2.0)], "k int, yhat double")
    write_forecasts(df, path, "007")
    write_forecasts(df, path, "8")
    write_forecasts(df.withColumn("yhat", F.lit(3.0)), path, "8")
    assert {(r.run_id, r.yhat) for r in read_forecasts(spark, path).collect()} == {("007", 2.0), ("8", 3.0)}
    assert read_forecasts(spark, path, "007").count() == 1


def test_an_ended_write_changes_nothing_for_readers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fc")
    df = spark.createDataFrame([(1, 2.0)], "k int, yhat double")
    write_forecasts(df, path, "a")
    broken = df.withColumn("yhat", F.raise_error(F.lit("ended")).cast("double"))
    with pytest.raises(Exception, match="ended"):
        write_forecasts(broken, path, "a")

    def ended(*_):
        raise RuntimeError("ended")
    with monkeypatch.context() as patch:  # all rows are there, but the pointer is not
        patch.setattr(store, "_pointers", ended)
        with pytest.raises(RuntimeError):
            write_forecasts(df.withColumn("yhat", F.lit(9.0)), path, "a")
    assert [tuple(r) for r in read_forecasts(spark, path).collect()] == [(1, 2.0, "a")]
    write_forecasts(df.withColumn("yhat", F.lit(3.0)), path, "a")
    write_forecasts(df, path, "b")
    assert drop_replaced(spark, path) >= 2 and drop_replaced(spark, path) == 0
    assert {(r.run_id, r.yhat) for r in read_forecasts(spark, path).collect()} == {("a", 3.0), ("b", 2.0)}
    with pytest.raises(ValueError, match="no such run"):
        read_forecasts(spark, path, "c")


def test_parent_sums_do_not_depend_on_the_order_of_rows(spark, pieces):
    rng = random.Random(3)
    rows = [(i % 4, i, 1, round(rng.choice([1e11, 1.0, 1e-3]) * rng.random(), 6)) for i in range(4000)]
    df = spark.createDataFrame(rows, "region_key int, nation_key int, horizon int, yhat double")
    sums = [sorted(map(tuple, R.bottom_up(d, run=["horizon"]).filter("level <> 'nation_key'").select("level", "region_key", "yhat").collect()), key=str)
            for d in (df, df.repartition(5), df.orderBy("yhat"))]
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) == 5


def test_defects_are_counted_as_in_plain_sets(spark, small):
    tables = read_tables(spark, small)
    def with_nulls(df, key, every):
        return df.withColumn(key, F.when(F.pmod(F.hash(*df.columns), F.lit(every)) != 0, F.col(key)))
    tables = type(tables)(**{
        "lineitem": with_nulls(with_nulls(tables.lineitem, "l_orderkey", 50), "l_partkey", 70), "orders": with_nulls(tables.orders, "o_custkey", 30),
        "customer": with_nulls(tables.customer.filter("c_custkey % 3 > 0"), "c_nationkey", 9), "part": tables.part.filter("p_partkey % 4 > 0"),
        "nation": tables.nation.filter("n_nationkey > 4"), "region": tables.region.union(tables.region.selectExpr("r_regionkey + 90", "r_name"))})
    got = {r.check: r.n for r in sales_quality(tables).collect()}
    for many, many_key, one, one_key, orphan, childless in LINKS:
        children = [r[0] for r in getattr(tables, many).select(many_key).collect()]
        parents = [r[0] for r in getattr(tables, one).select(one_key).collect()]
        assert got[orphan] == sum(c is None or c not in set(parents) for c in children), orphan
        assert got[childless] == sum(p is None or p not in set(children) for p in parents), childless
    assert got["null_lineitem_l_orderkey"] > 0 and got["null_orders_o_custkey"] > 0 and len(got) == 9 + 3 + 1 + 10
    empty = type(tables)(**{n: getattr(tables, n).limit(0) for n in type(tables).__dataclass_fields__})
    assert {r.n for r in sales_quality(empty).collect()} == {0}


# ---- plans

def test_defects_read_lines_and_orders_twice(spark, small):
    text = plan(sales_quality(read_tables(spark, small)))
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    count = lambda name: sum(f"{name}.parquet" in line for line in scans)
    assert {n: count(n) for n in ("lineitem", "orders", "customer", "part", "nation", "region")} == {
        "lineitem": 2, "orders": 2, "customer": 1, "part": 1, "nation": 1, "region": 1}


def test_filters_and_columns_reach_the_scan(spark, small):
    df = load_sales(spark, small, exclude_returns=True, columns=["order_key", "gross"],
                    since=F.lit(day("1996-01-01")), until=F.lit(day("1997-01-01")))
    text = plan(df)
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in text and "LessThan(o_orderdate,1997-01-01" in text
    assert "Not(EqualTo(l_returnflag,R))" in text
    assert "customer" not in text and "part.parquet" not in text and "nation" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in text


def test_feature_windows_share_one_shuffle(spark):
    df = series(spark, monthly(spark, range(30)))
    dense = P.densify(df, K, "month", (F.lit(day("2020-01-01")), F.lit(day("2022-06-01"))))
    out = X.FeatureSpec().from_panel(X.ewma(X.growth(dense, K, "y", 12), K, "y", 0.3, 6), K)
    assert plan(out).count("Exchange") == 1


def test_panels_join_without_products(spark, small):
    tables = read_tables(spark, small)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = plan(dense_panel(tables, ["region_key", "nation_key", "brand"], "month"))
        cube = plan(S.rolling_origin(dense_panel(tables, ["nation_key"], "month"), 3, 6,
                                     last=period_bounds(tables, "month")[1]))
    finally:
        spark.conf.set(key, before)
    for shown in (text, cube):
        assert "CartesianProduct" not in shown and "NestedLoop" not in shown and "Broadcast" not in shown
    assert "SortMergeJoin" in text
