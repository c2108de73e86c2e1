import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from panelcast.functions import metrics
from panelcast.models import additive, autoregressive, baseline, ensemble, folds, ridge, tournament, trees, trend
from panelcast.operators.features import numeric_features
from panelcast.reports import summaries


def value(spark, expression, pairs):
    df = spark.createDataFrame([(float(a), float(p)) for a, p in pairs], "a double, p double")
    return df.agg(expression(F.col("a"), F.col("p"))).first()[0]


PAIRS = list(zip([100, 120, 110, 130, 115], [105, 118, 108, 125, 120]))


def test_metric_literals(spark):
    assert value(spark, metrics.mae, PAIRS) == pytest.approx(3.8)
    assert value(spark, metrics.mse, PAIRS) == pytest.approx(16.6)
    expected = np.mean([5 / 100, 2 / 120, 2 / 110, 5 / 130, 5 / 115]) * 100
    for measure in (metrics.mape_positive, metrics.mape_raw, metrics.mape_epsilon):
        assert value(spark, measure, PAIRS) == pytest.approx(expected)


def test_zero_actuals(spark):
    assert value(spark, metrics.mape_positive, [(0, 3), (10, 5)]) == pytest.approx(50)
    assert value(spark, metrics.mape_positive, [(0, 3)]) == 0
    assert value(spark, metrics.mape_raw, [(0, 3), (10, 5)]) == float("inf")
    assert np.isnan(value(spark, metrics.mape_raw, [(0, 0), (10, 5)]))
    assert value(spark, metrics.mape_epsilon, [(0, 1)]) > 1e15
    assert value(spark, metrics.smape, [(0, 0), (1, 3)]) == pytest.approx(50)


def test_error_table_caps_and_falls_back(spark):
    df = spark.createDataFrame([("a", 1.0, 50.0)], "location string, actual double, yhat double")
    row = folds.error_table(df, "location").first()
    assert row.mape == 999 and row.accuracy == pytest.approx(100 - row.smape if row.smape < 100 else 0)


def test_mean_forecast_lowers_weekends(series_of, column):
    out = baseline.mean_forecast(series_of("2024-01-01", a=[10] * 4), 3)  # ends on a Thursday
    assert column(out, "yhat") == [10, 8.5, 8.5]


def test_unknown_key_gets_overall_mean(spark, series_of):
    requests = spark.createDataFrame([("a",), ("x",)], "location string")
    rows = baseline.requested_forecast(series_of("2024-01-01", a=[10] * 4, b=[20] * 4), requests, 1).collect()
    assert {r.location: r.yhat for r in rows} == {"a": 10.0, "x": 15.0}


def test_no_history_gives_the_fixed_level(spark, series_of):
    requests = spark.createDataFrame([("a",)], "location string")
    rows = baseline.requested_forecast(series_of(a=[1]).filter("y > 5"), requests, 2).collect()
    assert [(r.yhat, r.model) for r in rows] == [(5.0, "fallback")] * 2


def test_autoregression_matches_recursion(series_of, column):
    rng = np.random.default_rng(1)
    y = [20.0]
    for _ in range(300):
        y.append(4 + 0.8 * y[-1] + rng.normal())
    x0, x1 = np.array(y[:-1]), np.array(y[1:])
    phi, c = np.polyfit(x0, x1, 1)
    expected, last = [], y[-1]
    for _ in range(5):
        last = c + phi * last
        expected.append(last)
    got = column(autoregressive.autoregressive_forecast(series_of(a=y), 5), "yhat")
    assert got == [pytest.approx(v) for v in expected]


def test_differenced_forecast_returns_to_levels(series_of, column):
    out = autoregressive.autoregressive_forecast(series_of(a=[1.0, 2.0, 4.0, 8.0]), 2, order=(1, 1))
    assert column(out, "yhat") == [pytest.approx(16), pytest.approx(32)]


def test_constant_series_stays_constant(series_of, column):
    for order in autoregressive.ORDERS:
        assert column(autoregressive.autoregressive_forecast(series_of(a=[7.0] * 10), 3, order=order), "yhat") == [7, 7, 7]


def test_unit_root(series_of):
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    rows = autoregressive.stationarity(series_of(noise=noise.tolist(), walk=walk.tolist())).collect()
    assert {r.location: r.is_stationary for r in rows} == {"noise": True, "walk": False}


def test_rolling_folds(series_of):
    scored = folds.rolling_backtest(series_of(a=[float(i % 7 + 1) for i in range(366)], b=[1.0] * 200), **folds.ROLLING)
    assert scored.count() == 84
    first = dt.date(2024, 1, 1)
    starts = sorted({(r.cutoff - first).days - 179 for r in scored.collect()})
    assert starts == [0, 30, 60, 90, 120, 150]


def test_overlapping_folds_are_refused(series_of):
    with pytest.raises(ValueError):
        folds.rolling_origin(series_of(a=[1] * 9), 3, 2, 4)


def test_carried_training_state_equals_refit(series_of):
    rng = np.random.default_rng(3)
    y = rng.integers(1, 30, 260).astype(float)
    scored = folds.rolling_origin(series_of(a=y.tolist()), **folds.CV).collect()
    first = dt.date(2024, 1, 1)
    assert len({r.cutoff for r in scored}) == 3
    for row in scored:
        end = (row.cutoff - first).days + 1
        train = y[:end]
        weekend = 0.85 if row.ds.weekday() >= 5 else 1
        assert row.yhat_mean == pytest.approx(train.mean() * weekend)
        phi, c = np.polyfit(train[:-1], train[1:], 1)
        last = train[-1]
        for _ in range(row.step):
            last = c + phi * last
        assert row.yhat_ar == pytest.approx(last)


def test_cutoffs_agree_with_fold_rows(series_of):
    rows = folds.fold_rows(series_of(a=[1] * 240), **folds.CV)
    assert rows.filter("is_test").count() == 2 * 14
    sizes = rows.filter("not is_test").groupBy("cutoff").count().orderBy("cutoff").collect()
    assert [r["count"] for r in sizes] == [196, 226]


def test_ordered_splits(series_of):
    rows = folds.ordered_splits(series_of(a=[1] * 10)).orderBy("fold").collect()
    assert [(r.train_rows, r.test_end) for r in rows] == [(4, 6), (6, 8), (8, 10)]
    members = folds.split_members(series_of(a=[1] * 10)).orderBy("r").collect()
    assert [r.fold for r in members] == [None] * 4 + [1, 1, 2, 2, 3, 3]


def seasonal(n=800, seed=4):
    rng, t = np.random.default_rng(seed), np.arange(n)
    weekly = 6 * np.sin(2 * np.pi * t / 7)
    return (40 + 0.02 * t + weekly + 10 * np.sin(2 * np.pi * t / 365.25) + rng.normal(size=n)).round(3).tolist()


def plain_design(days, start, end, names):
    """The design of the additive model, day by day."""
    rows = []
    for day in days:
        t = (day - start).days / max((end - start).days, 1)
        row = [1.0, t, *(max(0.0, t - 0.8 * j / 11) for j in range(1, 11))]
        number = (day - dt.date(1970, 1, 1)).days
        for name, period, count in (("yearly", 365.25, 5), ("weekly", 7, 3), ("monthly", 30.5, 5), ("quarterly", 91.25, 8)):
            for k in range(1, count + 1) if name in names else ():
                row += [np.sin(2 * np.pi * k * number / period), np.cos(2 * np.pi * k * number / period)]
        if "regressors" in names:
            row += [float(day.weekday() >= 5), day.month / 12]
        rows.append(row)
    return np.array(rows)


def test_holdout_equals_direct_ridge(series_of):
    y, first = seasonal(300), dt.date(2024, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(300)]
    for mode in ("additive", "multiplicative"):
        params = {**additive.FORECAST, "seasonality_mode": mode}
        names = ridge.used_blocks({"p": params})
        penalty, active = ridge.penalties(params, names)
        assert active.all()
        x, target = plain_design(days, first, days[269], names), np.array(y) if mode == "additive" else np.log1p(y)
        beta = np.linalg.solve(x[:270].T @ x[:270] + np.diag(penalty), x[:270].T @ target[:270])
        band = 1.96 * np.sqrt(np.mean((target[:270] - x[:270] @ beta) ** 2))
        rows = additive.holdout(series_of(a=y), param_sets={"p": params}).orderBy("ds").collect()
        shown = np.asarray if mode == "additive" else np.expm1
        assert [r.yhat for r in rows] == pytest.approx(list(shown(x[270:] @ beta)), abs=1e-5)
        assert [r.yhat_upper for r in rows] == pytest.approx(list(shown(x[270:] @ beta + band)), abs=1e-4)
        assert [(r.step, r.actual) for r in rows] == [(i + 1, y[270 + i]) for i in range(30)]


def exchanges(df):
    import io
    from contextlib import redirect_stdout

    with redirect_stdout(io.StringIO()) as text:
        df.explain("simple")
    return text.getvalue().count("Exchange ")


def test_fits_and_predictions_share_one_exchange(series_of, spark, tmp_path):
    series_of(a=seasonal(260), b=seasonal(240)).write.parquet(str(tmp_path / "series"))
    saved = spark.read.parquet(str(tmp_path / "series"))
    sets = {"p": additive.COMPARISON, "q": additive.FORECAST}
    assert exchanges(additive.forecast(saved, 14, sets)) == 1
    assert exchanges(additive.holdout(saved, 30, sets)) == 1
    assert exchanges(additive.cross_validate(saved, sets, **folds.CV)) == 1
    assert exchanges(additive.rolling_backtest(saved, **folds.ROLLING)) == 1


def test_short_and_gappy_series(series_of):
    df = series_of(a=[None, *seasonal(100), None], b=[1.0] * 12, c=[None] * 40)
    rows = additive.forecast(df, 3).collect()
    assert {r.location for r in rows} == {"a"} and len(rows) == 3
    assert all(np.isfinite([r.yhat, r.yhat_lower, r.yhat_upper]).all() for r in rows)
    assert additive.forecast(df.limit(0), 3).count() == 0


def test_gram_means(series_of):
    y, first = seasonal(80), dt.date(2024, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(80)]
    x = np.column_stack([plain_design(days, first, days[-1], ("yearly", "weekly")), y, np.log1p(y)])
    rows = additive.gram_means(series_of(a=y)).collect()
    assert len(rows) == 30 * 31 // 2
    assert max(abs(r["mean"] - (x[:, r["i"]] * x[:, r["j"]]).mean()) for r in rows) < 1e-8


def test_tournament(series_of):
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(size=300)) + 200
    df = series_of(season=seasonal(400), walk=walk.tolist(), short=[3.0] * 40)
    few = dict(list(additive.parameter_grid().items())[:3])
    rows = tournament.predictions(df, param_sets=few).cache()
    assert {(r.location, r.model) for r in rows.collect()} == {(k, m) for k in ("season", "walk") for m in tournament.MODELS}
    assert rows.count() == 2 * 4 * 30
    # what is tuned does not change with the values of the test rows
    last = F.row_number().over(Window.partitionBy("location").orderBy(F.desc("ds"))) <= 30
    other = tournament.predictions(df.withColumn("y", F.when(last, F.lit(1.0)).otherwise(F.col("y"))), param_sets=few)
    same = lambda t: sorted((r.model, r.location, r.ds, r.yhat, r.choice or "") for r in t.collect())
    assert same(rows) == same(other)
    scored = tournament.scores(rows).cache()
    best = {r.location: r.best_model for r in ensemble.best_model(scored).collect()}
    assert best["season"] in (tournament.TUNED, tournament.COMBINED)
    chosen = {r.location: r for r in tournament.single_or_ensemble(scored).collect()}
    mape = {(r.location, r.model): r.mape for r in scored.collect()}
    for k in ("season", "walk"):
        assert chosen[k].mape == min(mape[k, tournament.TUNED], mape[k, tournament.COMBINED])
    table = tournament.accuracy_table(scored).collect()
    assert all((r["rank"] == 1) == (r.model == r.winner) for r in table)


def test_expanding_folds_equal_separate_fits(series_of):
    y = seasonal(260)
    scored = additive.cross_validate(series_of(a=y), {"p": additive.COMPARISON}, **folds.CV)
    assert scored.groupBy("cutoff").count().count() == 3
    last = scored.filter(F.col("fold") == 0).orderBy("ds").collect()
    single = additive.holdout(series_of(a=y), 14, {"p": additive.COMPARISON}).orderBy("ds").collect()
    # the trend position is relative to the training span of each call, so agreement is close, not exact
    assert [r.ds for r in last] == [r.ds for r in single]
    assert max(abs(a.yhat - b.yhat) for a, b in zip(last, single)) < 1.0


def test_rolling_segments_cover_the_same_rows_as_the_baseline(series_of):
    y = seasonal(366)
    got = additive.rolling_backtest(series_of(a=y), **folds.ROLLING).select("location", "cutoff", "ds", "step")
    want = folds.rolling_backtest(series_of(a=y), **folds.ROLLING).select("location", "cutoff", "ds", "step")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_additive_beats_the_mean_on_seasonal_data(series_of):
    df = series_of(a=seasonal())
    model = folds.error_table(additive.holdout(df), "location").first()
    mean = folds.error_table(baseline.holdout_forecast(df), "location").first()
    assert model.mape < mean.mape / 2 and model.mape < 10


def test_additive_band_is_calibrated_on_the_fitted_days(series_of):
    every = F.lit(0)
    inside = additive._predicted(series_of(a=seasonal()), every, every, every, {"p": additive.FORECAST}, "full", 1, "location", "ds", "y")
    share = inside.agg(metrics.coverage(F.col("actual"), F.col("yhat_lower"), F.col("yhat_upper"))).first()[0]
    assert 0.9 < share < 0.99


def test_grid_is_seeded_and_best_set_is_reported(series_of):
    grid = additive.parameter_grid()
    assert len(grid) == 20 and grid == additive.parameter_grid()
    few = dict(list(grid.items())[:3])
    rows = additive.grid_search(series_of(a=seasonal(300), b=[1.0] * 20), few).collect()
    best = {r.location: r for r in rows}
    assert best["a"].params in few and best["a"].mape > 0
    assert json.loads(best["b"].params) == additive.DEFAULTS and best["b"].mape is None


def test_ensemble_band(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", day, float(v), m) for v, m in ((1, "x"), (3, "y"), (5, "z"))], "location string, ds date, yhat double, model string")
    row = ensemble.ensemble(df).first()
    assert (row.yhat, row.yhat_std) == (3, 2) and row.yhat_upper == pytest.approx(3 + 1.96 * 2)


def test_best_model_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("a", "y", 5.0), ("a", "x", 5.0), ("b", "y", 1.0), ("b", "x", 60.0)], "location string, model string, mape double")
    assert {r.location: r.best_model for r in ensemble.best_model(df).collect()} == {"a": "x", "b": "y"}
    rows = {r.model: r for r in ensemble.model_comparison(df).collect()}
    assert rows["y"].is_best_overall and not rows["x"].is_best_overall and rows["x"].wins == 1


def test_tree_model_and_frozen_lags(spark, series_of):
    frame = trees.model_features(series_of(a=seasonal(200), short=[1.0] * 30)).cache()
    names = numeric_features(frame)
    assert frame.select("location").distinct().count() == 1
    scored = trees.holdout(frame, names, {"maxIter": 30, "maxDepth": 3})
    assert scored.count() == 30
    assert scored.agg(metrics.mape_positive(F.col("actual"), F.col("yhat"))).first()[0] < 25
    assert sorted(scored.collect()) == sorted(trees.holdout(frame, names, {"maxIter": 30, "maxDepth": 3}).collect())
    assert trees.forecast(frame, names, 5, {"maxIter": 5}).count() == 5
    shares = trees.importances(frame, names, {"maxIter": 10}).collect()
    assert [r.feature for r in shares] == [*names, trees.LEVEL] and sum(r.importance for r in shares) == pytest.approx(1)
    assert trees.random_trials(3) == trees.random_trials(3)


def test_trees_without_rows_give_no_predictions(spark, series_of):
    frame = trees.model_features(series_of(short=[1.0] * 30))
    names = numeric_features(frame)
    assert trees.holdout(frame, names).count() == trees.importances(frame, names).count() == trees.series_importances(frame, names).count() == 0
    untrained = trees.model_features(series_of(a=seasonal(70))).withColumn("is_train", F.lit(False))
    assert {r.yhat for r in trees.fit_predict(untrained, names).collect()} == {None}


def test_series_importances_find_the_input_that_drives_each_series(spark):
    first = dt.date(2024, 1, 1)
    noise = np.random.default_rng(3).integers(0, 10, (2, 200)).tolist()
    # both series follow their first input, the flat one by a hundredth
    rows = [(k, first + dt.timedelta(days=i), float(p) * scale, float(p), float(q)) for k, scale in (("steep", 10.0), ("flat", 0.1)) for i, (p, q) in enumerate(zip(*noise))]
    frame = spark.createDataFrame(rows, "location string, ds date, y double, `in.a` double, b double")
    scores = {(r.location, r.feature): r.importance for r in trees.series_importances(frame, ["in.a", "b"], {"maxIter": 15, "maxDepth": 4}).collect()}
    assert len(scores) == 4 and scores["steep", "in.a"] > 10 > 10 * abs(scores["steep", "b"])
    assert scores["steep", "in.a"] > 20 * abs(scores["flat", "in.a"])


def test_search_keeps_the_least_error_to_the_last_step(spark, series_of):
    frame = trees.model_features(series_of(a=seasonal(200), b=seasonal(150)))
    trials = [{"maxIter": 1, "maxDepth": 1, "stepSize": 0.01}, {"maxIter": 12, "maxDepth": 3}, {"maxIter": 1, "maxDepth": 2, "stepSize": 0.01}]
    rows = {r.trial: r for r in trees.search(frame, numeric_features(frame), trials, steps=2, share=3).collect()}
    assert [t for t, r in rows.items() if r.is_best] == [1]
    assert {t: r.rounds for t, r in rows.items()} == {0: 1, 1: 12, 2: 1}
    whole = trees.search(frame, numeric_features(frame), trials, steps=1).collect()
    assert [(r.trial, r.rounds, r.mae) for r in whole if r.is_best] == [(1, 12, pytest.approx(rows[1].mae))]


def test_pooled_trees_beat_the_average_of_each_series(spark, series_of):
    frame = trees.model_features(series_of(a=seasonal(300), b=seasonal(260)))
    mape = metrics.mape_positive(F.col("actual"), F.col("yhat"))
    ours = {r.location: r[1] for r in trees.holdout(frame, numeric_features(frame), {"maxIter": 60}).groupBy("location").agg(mape).collect()}
    plain = {r.location: r[1] for r in baseline.holdout_forecast(frame.select("location", "ds", "y", "is_weekend")).groupBy("location").agg(mape).collect()}
    assert all(ours[k] <= plain[k] for k in ours)


def test_polynomial_trend_recovers_a_cubic(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 2.0 + 0.5 * i + 1e-5 * i**3) for i in range(1100)]
    out = trend.polynomial_trend(spark.createDataFrame(rows, "ds date, y double"))
    parts = {r.part: r["count"] for r in out.groupBy("part").count().collect()}
    assert parts == {"skipped": 922, "train": 165, "test": 13, "future": 10}
    assert out.filter("part = 'test'").agg(F.max(F.abs(F.col("actual") - F.col("yhat")))).first()[0] < 1e-3


def test_alert_levels(spark):
    df = spark.createDataFrame([(50, 100), (70, 100), (95, 100), (5, 0)], "u int, c int")
    assert [r[0] for r in df.select(summaries.alert_level(F.col("u"), F.col("c"))).collect()] == ["low", "medium", "high", "high"]


def test_lookup_checks_its_request(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, "m")], "location string, ds date, yhat double, model string")
    assert summaries.forecast_lookup(df, "a", "m", 5, ["m"]).count() == 1
    for days, model in ((0, "m"), (91, "m"), (5, "other")):
        with pytest.raises(ValueError):
            summaries.forecast_lookup(df, "a", model, days, ["m"])


def test_served_values(spark):
    df = spark.createDataFrame([(-3.0, None), (10.126, 4.0)], "yhat double, low double")
    rows = baseline.served(df, lower="low").collect()
    assert [(r.predicted_admissions, r.lower_bound, r.upper_bound) for r in rows] == [(0, 0, 0), (10.13, 4, 12.15)]
