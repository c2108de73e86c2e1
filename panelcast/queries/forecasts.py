"""Forecasting, selection and validation queries (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import additive, autoregressive, baseline, ensemble, folds, tournament, trees, trend
from ..models.ridge import width
from ..operators.features import numeric_features
from ..sources import files, tables
from .additive_sql import design_sql, fit_sql, predict_sql
from .calendar import after_views
from .joins import all_forecasts, holdout_scores
from .registry import q6, query, rounded
from .views import ERRORS, VIEWS, ar_steps, backtest_sql, with_views

@query(
    "m01_mean_forecast",
    with_views(
        f"""SELECT q.location, m.m + s.step AS ds, {q6("round(coalesce(l.level, m.level) * CASE WHEN isodow(m.m + s.step) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 2)", 'yhat')},
                   'historical_average' AS model
            FROM (SELECT r_name AS location FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey = 0) q
            LEFT JOIN (SELECT location, avg(y) AS level FROM series GROUP BY location) l ON q.location = l.location,
                 (SELECT max(ds) AS m, avg(y) AS level FROM series) m, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15)) s""",
        "series",
    ),
)
def m01(spark, sf):
    """Forecast for all regions and for a name that has no series of its own."""
    unknown = tables.table(spark, sf, "nation").filter(F.col("n_nationkey") == 0).select(F.col("n_name").alias("location"))
    requests = tables.table(spark, sf, "region").select(F.col("r_name").alias("location")).union(unknown)
    return rounded(baseline.requested_forecast(tables.series(spark, sf), requests))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


AHEAD = "(SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))"
FORECAST_YHAT = predict_sql("(e + step)", additive.FORECAST)


@query(
    "m02_additive_forecast",
    recursive(
        after_views(
            f"""SELECT location, e + step AS ds, CAST(step AS BIGINT) AS step, {q6(FORECAST_YHAT[0], 'yhat')}, {q6(FORECAST_YHAT[1], 'yhat_lower')}, {q6(FORECAST_YHAT[2], 'yhat_upper')}, 'additive' AS model
                FROM a_fit, {AHEAD}""",
            fit_sql("a", "series", additive.FORECAST),
            "series",
        )
    ),
)
def m02(spark, sf):
    return rounded(additive.forecast(tables.series(spark, sf)))


@query(
    "m02_additive_holdout",
    recursive(
        after_views(
            f"""SELECT location, {", ".join(q6(c) for c in ("mae", "mse", "rmse"))}, {q6("least(mape0, 999)", "mape")}, {q6("smape")},
                       {q6("greatest(0, least(100, 100 - CASE WHEN mape0 < 200 THEN mape0 ELSE smape END))", "accuracy")}, {q6("mean_actual")}, {q6("mean_predicted")}, non_zero_samples, test_days
                FROM (SELECT location, {ERRORS.format(p="yhat")} FROM tested GROUP BY location)""",
            "train AS (SELECT location, ds, y FROM positions WHERE r < n - 30 AND n >= 60),\n"
            + fit_sql("a", "train", additive.FORECAST)
            + f",\ntested AS (SELECT p.location, p.y AS actual, {predict_sql('p.ds', additive.FORECAST)[0]} AS yhat FROM positions p JOIN a_fit USING (location) WHERE p.r >= p.n - 30)",
            "positions",
        )
    ),
)
def m02_holdout(spark, sf):
    scored = additive.holdout(tables.series(spark, sf))
    return rounded(folds.error_table(scored, "location"))


DESIGN = ("base", "changepoint", "yearly", "weekly")


@query(
    "m02_gram_means",
    with_views(
        f"""SELECT location, i - 1 AS i, j - 1 AS j, {q6('avg(x[i] * x[j])', 'mean')} FROM (
              SELECT location, {design_sql('ds', 's', 'e', DESIGN)} || [CAST(y AS DOUBLE), ln(1 + CAST(y AS DOUBLE))] AS x
              FROM (SELECT location, ds, y, min(ds) OVER (PARTITION BY location) AS s, max(ds) OVER (PARTITION BY location) AS e FROM series)),
              range(1, {width(DESIGN) + 3}) a(i), range(1, {width(DESIGN) + 3}) b(j) WHERE i <= j GROUP BY ALL""",
        "series",
    ),
)
def m02_gram(spark, sf):
    """What a fit is made of: the mean products of the design columns and the target."""
    return rounded(additive.gram_means(tables.series(spark, sf), DESIGN))


@query(
    "m03_future_frame",
    with_views(
        """SELECT location, step, m + step AS ds, CASE WHEN isodow(m + step) >= 6 THEN 1 ELSE 0 END AS is_weekend, month(m + step) AS month
           FROM (SELECT location, max(ds) AS m FROM series GROUP BY location), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))""",
        "series",
    ),
)
def m03(spark, sf):
    return rounded(baseline.future_days(tables.series(spark, sf)))


def tree_frame(spark, sf):
    """Model inputs of all series and their names."""
    frame = trees.model_features(tables.series(spark, sf))
    return frame, numeric_features(frame)


@query("m04_boosted_trees")
def m04(spark, sf):
    frame, names = tree_frame(spark, sf)
    return rounded(folds.error_table(trees.holdout(frame, names), "location"))


@query("m05_feature_importance")
def m05(spark, sf):
    frame, names = tree_frame(spark, sf)
    return rounded(trees.importances(frame, names))


@query("m06_tree_forecast")
def m06(spark, sf):
    frame, names = tree_frame(spark, sf)
    return rounded(trees.forecast(frame, names))


STEPS = {
    "ar0_diff0": "level",
    "ar0_diff1": "y1",
    "ar1_diff0": "constant + phi * y1",
    "ar1_diff1": "y1 + phi_diff * (y1 - y2)",
}
UNIT_ROOT_SQL = """unit AS (SELECT location, count(*) AS n_pairs, regr_slope(d, x) AS slope,
  regr_slope(d, x) / sqrt((regr_syy(d, x) - regr_slope(d, x) * regr_slope(d, x) * regr_sxx(d, x)) / (count(*) - 2) / regr_sxx(d, x)) AS t_stat
  FROM (SELECT location, y - lag(y) OVER w AS d, CAST(lag(y) OVER w AS DOUBLE) AS x FROM series WINDOW w AS (PARTITION BY location ORDER BY ds))
  WHERE d IS NOT NULL GROUP BY location)"""
ORDER_SQL = f"""{UNIT_ROOT_SQL},
steps AS (SELECT s.location, CAST(s.y AS DOUBLE) AS y, lag(CAST(s.y AS DOUBLE)) OVER w AS y1, lag(CAST(s.y AS DOUBLE), 2) OVER w AS y2, f.level, f.phi, f.constant, f.phi_diff
  FROM series s JOIN ar_fit f ON s.location = f.location WINDOW w AS (PARTITION BY s.location ORDER BY s.ds)),
errors AS ({' UNION ALL '.join(f"SELECT location, '{m}' AS model, avg(abs((y - ({e})) / y)) * 100 AS mape, {m[-1]} AS differences FROM steps GROUP BY location" for m, e in STEPS.items())}),
chosen AS (SELECT location, arg_min(model, mape) AS model, min(mape) AS mape FROM errors JOIN unit USING (location) WHERE t_stat < -2.86 OR differences = 1 GROUP BY location)"""
MANY_SQL = f"""CASE model WHEN 'ar0_diff0' THEN level WHEN 'ar0_diff1' THEN last_y
  WHEN 'ar1_diff0' THEN {ar_steps('phi', 'constant', 'last_y', 'step')}
  ELSE last_y + (last_y - last_y1) * phi_diff * (1 - pow(phi_diff, step)) / (1 - phi_diff) END"""


@query(
    "m07_autoregression",
    after_views(
        f"""SELECT location, last_ds + step AS ds, step, {q6(MANY_SQL, 'yhat')}, model, {q6('mape')}
            FROM ar_fit JOIN chosen USING (location), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))""",
        ORDER_SQL,
        "ar_fit",
    ),
)
def m07(spark, sf):
    return rounded(autoregressive.best_autoregressive_forecast(tables.series(spark, sf)))


# the same tables of the rows before the test rows
TRAIN_SQL = ",\n".join(
    [
        "train AS (SELECT location, ds, y, n AS whole FROM positions WHERE r < n - 30 AND n >= 60)",
        "train_fit AS (" + VIEWS["ar_fit"][1].replace("FROM series", "FROM train") + ")",
        ORDER_SQL.replace("FROM series", "FROM train").replace("JOIN ar_fit", "JOIN train_fit"),
    ]
)


@query(
    "m07_selected_holdout",
    after_views(
        f"""SELECT location, p.ds, CAST(p.r - (p.n - 31) AS BIGINT) AS step, p.y AS actual, model AS order_chosen, {q6(MANY_SQL, 'yhat')}
            FROM (SELECT *, r - (n - 31) AS step FROM positions WHERE r >= n - 30 AND n >= 60) p JOIN train_fit f USING (location) JOIN chosen USING (location)""",
        TRAIN_SQL,
        "positions",
    ),
)
def m07_selected(spark, sf):
    """The order is chosen on the rows before the test rows."""
    return rounded(autoregressive.selected_holdout(tables.series(spark, sf)).withColumnRenamed("order", "order_chosen"))


@query(
    "m08_stationarity",
    after_views(f"SELECT location, n_pairs, {q6('slope')}, {q6('t_stat')}, t_stat < -2.86 AS is_stationary FROM unit", UNIT_ROOT_SQL, "series"),
)
def m08(spark, sf):
    return rounded(autoregressive.stationarity(tables.series(spark, sf)))


@query(
    "m09_ensemble",
    with_views(
        f"""SELECT location, ds, {q6('m', 'yhat')}, {q6('s', 'yhat_std')}, members, {q6('m - 1.96::DOUBLE * s', 'yhat_lower')}, {q6('m + 1.96::DOUBLE * s', 'yhat_upper')}
            FROM (SELECT location, ds, avg(yhat) AS m, stddev_samp(yhat) AS s, count(*) AS members FROM forecasts GROUP BY location, ds)""",
        "forecasts",
    ),
)
def m09(spark, sf):
    return rounded(ensemble.ensemble(all_forecasts(spark, sf)))


@query(
    "m09_additive_ensemble",
    recursive(
        after_views(
            f"""SELECT location, ds, {q6('avg(yhat)', 'yhat')}, {q6('stddev_samp(yhat)', 'yhat_std')}, count(*) AS members,
                       {q6('avg(yhat) - 1.96::DOUBLE * stddev_samp(yhat)', 'yhat_lower')}, {q6('avg(yhat) + 1.96::DOUBLE * stddev_samp(yhat)', 'yhat_upper')}
                FROM ({" UNION ALL ".join(f"SELECT location, e + step AS ds, {predict_sql('(e + step)', p)[0]} AS yhat FROM {m}_fit, {AHEAD}" for m, p in additive.ENSEMBLE.items())}) GROUP BY location, ds""",
            ",\n".join(fit_sql(m, "series", p) for m, p in additive.ENSEMBLE.items()),
            "series",
        )
    ),
)
def m09_additive(spark, sf):
    """The three additive configurations combined; they share one pass over the data."""
    members = additive.forecast(tables.series(spark, sf), param_sets=additive.ENSEMBLE)
    return rounded(ensemble.ensemble(members))


@query("m10_grid_search")
def m10(spark, sf):
    return rounded(additive.grid_search(tables.series(spark, sf)))


@query("m11_random_search")
def m11(spark, sf):
    frame, names = tree_frame(spark, sf)
    return rounded(trees.search(frame, names, trees.random_trials()))


@query(
    "m12_ordered_splits",
    with_views(
        """SELECT location, n, fold, n - (4 - fold) * (n // 4) AS train_rows, n - (4 - fold) * (n // 4) AS test_start, n - (4 - fold) * (n // 4) + n // 4 AS test_end
           FROM (SELECT location, count(*) AS n FROM series GROUP BY location), (SELECT range AS fold FROM range(1, 4))""",
        "series",
    ),
)
def m12(spark, sf):
    return rounded(folds.ordered_splits(tables.series(spark, sf)))


@query(
    "m13_rolling_origin",
    with_views(f"SELECT location, cutoff, ds, step, actual, {q6('yhat_mean')}, {q6('yhat_ar')} FROM origin", "origin"),
)
def m13(spark, sf):
    return rounded(folds.rolling_origin(tables.series(spark, sf), **folds.CV))


@query("m13_additive_cv")
def m13_additive(spark, sf):
    scored = additive.cross_validate(tables.series(spark, sf), {"backtest": additive.BACKTEST}, **folds.CV)
    per_step = folds.horizon_metrics(scored, "yhat", F.col("yhat_lower"), F.col("yhat_upper"))
    return rounded(folds.mean_over_horizons(per_step))


@query(
    "m14_rolling_backtest",
    with_views(
        "SELECT location, "
        + ", ".join(q6(c) for c in ("mae", "mse", "rmse", "mape", "directional_accuracy"))
        + f", total_predictions FROM ({backtest_sql('rolling', 'yhat_ar')})",
        "rolling",
    ),
)
def m14(spark, sf):
    scored = folds.rolling_backtest(tables.series(spark, sf), **folds.ROLLING)
    return rounded(folds.backtest_metrics(scored, "yhat_ar"))


@query("m14_additive_backtest")
def m14_additive(spark, sf):
    scored = additive.rolling_backtest(tables.series(spark, sf), **folds.ROLLING)
    return rounded(folds.backtest_metrics(scored, "yhat"))


@query(
    "m15_holdout_evaluation",
    with_views(
        "SELECT location, "
        + ", ".join(q6(c) for c in ("mae", "mse", "rmse", "mape", "smape", "accuracy", "mean_actual", "mean_predicted"))
        + ", non_zero_samples, test_days FROM mean_scores",
        "mean_scores",
    ),
)
def m15(spark, sf):
    return rounded(folds.error_table(baseline.holdout_forecast(tables.series(spark, sf)), "location"))


@query(
    "m16_model_comparison",
    with_views(
        f"""SELECT s.model, {q6('avg(s.mape)', 'avg_mape')}, count(*) AS locations, count(*) FILTER (WHERE s.model = b.best) AS wins,
                   count(*) FILTER (WHERE s.model = b.best AND s.mape < 50) AS wins_below_50,
                   avg(s.mape) = min(avg(s.mape)) OVER () AS is_best_overall
            FROM scores s JOIN (SELECT location, arg_min(model, mape) AS best FROM scores GROUP BY location) b ON s.location = b.location GROUP BY s.model""",
        "scores",
    ),
)
def m16(spark, sf):
    return rounded(ensemble.model_comparison(holdout_scores(spark, sf)))


@query(
    "m17_single_or_ensemble",
    with_views(
        f"""SELECT location, {q6('a', 'single_mape')}, {q6('b', 'ensemble_mape')}, CASE WHEN b < a THEN 'ensemble' ELSE 'single' END AS model_type,
                   {q6('least(a, b)', 'mape')}, least(a, b) > 50 AS improvement_needed
            FROM (SELECT m.location, m.mape AS a, e.mape AS b FROM ar_scores m JOIN
                  (SELECT a.location, avg(abs((a.actual - (a.yhat + m.yhat) / 2) / a.actual)) FILTER (WHERE a.actual > 0) * 100 AS mape
                   FROM ar_test a JOIN mean_test m ON a.location = m.location AND a.ds = m.ds GROUP BY a.location) e ON m.location = e.location)""",
        "ar_scores",
        "mean_test",
    ),
)
def m17(spark, sf):
    """The autoregression against its mean with the historical average."""
    series = tables.series(spark, sf)
    members = baseline.holdout_forecast(series).unionByName(autoregressive.holdout_forecast(series))
    combined = members.groupBy("location", "ds").agg(F.max("actual").alias("actual"), F.avg("yhat").alias("yhat"))
    single = folds.error_table(autoregressive.holdout_forecast(series), "location")
    return rounded(ensemble.single_or_ensemble(single, folds.error_table(combined, "location")))


def tournament_scores(spark, sf):
    """Hold-out measures of all families, from one table of their predictions."""
    return tournament.scores(files.checkpointed(tournament.predictions(tables.series(spark, sf)), "tournament"))


@query("m16_tournament")
def m16_tournament(spark, sf):
    return rounded(ensemble.model_comparison(tournament_scores(spark, sf)))


@query("m17_tournament")
def m17_tournament(spark, sf):
    return rounded(tournament.single_or_ensemble(tournament_scores(spark, sf)))


def trend_sql() -> str:
    """Normal equations from power sums of the training days, solved stage by stage."""
    solved = "sums"
    for stage in trend.elimination(4):
        solved = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in stage.items())} FROM {solved})"
    powers = [f"sum({trend.power('t', k)}::DOUBLE) AS p{k}" for k in range(7)] + [f"sum(label * {trend.power('t', k)}) AS q{k}" for k in range(4)]
    yhat = " + ".join(f"c{k} * {trend.power('t', k)}" for k in range(4))
    return with_views(
        f"""SELECT ds, {q6('CAST(day AS DOUBLE)', 'day')}, {q6('label', 'actual')}, {q6(yhat, 'yhat')}, part FROM parts, {solved} s""",
        "daily",
    ).replace(
        "\nSELECT ds, round",
        f""",
totals AS (SELECT ds, CAST(sum(y) AS DOUBLE) AS label FROM daily GROUP BY ds),
span AS (SELECT min(ds) AS a, max(ds) AS b, max(ds) - min(ds) AS size FROM totals),
numbered AS (SELECT ds, label, ds - a AS day, 0 AS future, size FROM totals, span UNION ALL SELECT b + k, NULL, size + k, 1, size FROM span, (SELECT CAST(range AS INTEGER) AS k FROM range(1, 11))),
parts AS (SELECT *, CASE WHEN future = 1 THEN 'future' WHEN day < 922 THEN 'skipped' WHEN day < size + 1 - ceil((size + 1 - 922) * 0.07::DOUBLE) THEN 'train' ELSE 'test' END AS part,
  CAST(2 * day - size AS DOUBLE) / greatest(size, 1) AS t FROM numbered),
sums AS (SELECT {', '.join(powers)} FROM parts WHERE part = 'train')
SELECT ds, round""",
        1,
    )


@query("m19_polynomial_trend", trend_sql())
def m19(spark, sf):
    daily = tables.daily(spark, sf).groupBy("ds").agg(F.sum("y").alias("y"))
    return rounded(trend.polynomial_trend(daily))


@query(
    "m20_served_forecast",
    with_views(
        f"""SELECT location, ds, model, {q6('greatest(0, round(yhat, 2))', 'predicted_admissions')}, {q6('greatest(0, round(yhat * 0.8::DOUBLE, 2))', 'lower_bound')},
                   {q6('greatest(0, round(yhat * 1.2::DOUBLE, 2))', 'upper_bound')} FROM forecasts""",
        "forecasts",
    ),
)
def m20(spark, sf):
    served = baseline.served(all_forecasts(spark, sf))
    return rounded(served.select("location", "ds", "model", "predicted_admissions", "lower_bound", "upper_bound"))
