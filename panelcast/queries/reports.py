"""Report and look-up queries (Q) and the feature grouping (S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import baseline, folds, tournament
from ..operators import relevance
from ..operators.features import CATEGORY_FRAGMENTS, categorise
from ..operators.keys import named
from ..reports import summaries
from ..sources import tables
from .aggregates import CLASSES_SQL, CORRELATION_SQL, LONG_SQL, cv_scores, feature_frame, with_clause
from .forecasts import tournament_scores
from .joins import all_forecasts, holdout_scores
from .registry import q6, query, rounded
from .views import with_views


def rolling_scores(spark, sf):
    scored = folds.rolling_backtest(tables.series(spark, sf), **folds.ROLLING)
    return folds.backtest_metrics(scored, "yhat_ar")


def overall_performance(spark, sf):
    return summaries.overall_performance(cv_scores(spark, sf), rolling_scores(spark, sf))


@query(
    "q01_collection_summary",
    with_views(
        f"""SELECT min(date) AS start_date, max(date) AS end_date, count(DISTINCT date) AS days, count(DISTINCT location) AS locations,
                   count(DISTINCT disease_type) AS diseases, count(DISTINCT age_group) AS age_groups, count(*) AS admission_records,
                   {q6('avg(admission_count)', 'avg_daily_admissions')}, max(admission_count) AS max_daily_admissions, CAST(sum(admission_count) AS BIGINT) AS total_admissions,
                   (SELECT count(*) FROM capacity) AS capacity_records, count(*) + (SELECT count(*) FROM capacity) AS total_records,
                   {q6('(SELECT avg(total_beds) FROM capacity)', 'avg_total_beds')}, {q6('(SELECT avg(icu_beds) FROM capacity)', 'avg_icu_beds')} FROM admissions""",
        "capacity",
    ),
)
def q01(spark, sf):
    return rounded(summaries.collection_summary(tables.admissions(spark, sf), tables.day_capacity(spark, sf)))


QUALITY_COLUMNS = ("date", "location", "disease_type", "age_group", "admission_count")
MISSING_SQL = " || ',' || ".join(f"""'"{c}":' || count(*) FILTER (WHERE {c} IS NULL)""" for c in QUALITY_COLUMNS)


@query(
    "q02_data_quality",
    with_views(
        f"""SELECT count(*) AS total_records, strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date,
                   date_diff('day', min(date), max(date)) AS days, count(DISTINCT location) AS locations, '{{' || {MISSING_SQL} || '}}' AS missing_values,
                   {q6('avg(admission_count)', 'mean_daily_admissions')}, {q6('stddev_samp(admission_count)', 'std_daily_admissions')},
                   min(admission_count) AS min_admissions, max(admission_count) AS max_admissions, {q6('median(admission_count)', 'median_daily_admissions')} FROM dirty""",
        "dirty",
    ),
)
def q02(spark, sf):
    return rounded(summaries.data_quality(tables.dirty_admissions(spark, sf)))


@query(
    "q03_history_pattern",
    with_views(
        f"""SELECT p.location, p.total_records, p.start_date, p.end_date, {q6('mean_y')}, {q6('std_y')}, min_y, max_y, {q6('slope')}, peak_month, trough_month,
                   {q6('std_y / mean_y * 100', 'volatility')}, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction
            FROM (SELECT location, count(*) AS total_records, min(ds) AS start_date, max(ds) AS end_date, avg(y) AS mean_y, stddev_samp(y) AS std_y,
                         min(y) AS min_y, max(y) AS max_y, regr_slope(y, r) AS slope FROM positions GROUP BY location) p
            JOIN (SELECT location, arg_max(m, v * 1000 - m / 1000) AS peak_month, arg_min(m, v * 1000 + m / 1000) AS trough_month
                  FROM (SELECT location, month AS m, avg(y) AS v FROM series GROUP BY ALL) GROUP BY location) t ON p.location = t.location""",
        "positions",
    ),
)
def q03(spark, sf):
    return rounded(summaries.history_pattern(tables.series(spark, sf)))


SPREAD_SQL = ", ".join(q6(f"{f}({c})", f"{n}_{c}") for c in ("cv_mape", "rolling_mape") for n, f in (("avg", "avg"), ("best", "min"), ("worst", "max")))
SUMMARY_SQL = f"""SELECT count(*) AS total_locations, {SPREAD_SQL}, {q6('avg(directional_accuracy)', 'avg_directional_accuracy')},
  arg_min(location, avg_mape) AS best_performing_location, arg_max(location, avg_mape) AS worst_performing_location FROM overall"""


@query("q04_backtest_summary", with_views(SUMMARY_SQL, "overall"))
def q04(spark, sf):
    return rounded(summaries.backtest_summary(overall_performance(spark, sf)))


@query(
    "q05_findings",
    with_views(
        """SELECT NULL AS location, 'overall: ' || CASE WHEN avg(cv_mape) < 10 THEN 'excellent' WHEN avg(cv_mape) < 15 THEN 'good' WHEN avg(cv_mape) < 20 THEN 'acceptable' ELSE 'needs improvement' END AS finding FROM overall
           UNION ALL SELECT NULL, 'advice: tune features or model' FROM overall HAVING avg(cv_mape) > 20
           UNION ALL SELECT NULL, 'advice: improve trend analysis' FROM overall HAVING avg(directional_accuracy) < 50
           UNION ALL SELECT location, CASE WHEN avg_mape < 10 THEN 'excellent' ELSE 'needs improvement' END FROM overall WHERE avg_mape < 10 OR avg_mape > 20""",
        "overall",
    ),
)
def q05(spark, sf):
    overall = overall_performance(spark, sf)
    return summaries.findings(overall, summaries.backtest_summary(overall))


@query(
    "q06_overall_performance",
    with_views(
        f"SELECT location, {q6('cv_mape')}, {q6('rolling_mape')}, {q6('directional_accuracy')}, total_predictions, {q6('avg_mape')} FROM overall", "overall"
    ),
)
def q06(spark, sf):
    return rounded(overall_performance(spark, sf))


FRAGMENT_SQL = ", ".join(f"({i}, '{g}', '{p}')" for i, (g, parts) in enumerate(CATEGORY_FRAGMENTS.items()) for p in parts)
GROUP_SQL = f"SELECT DISTINCT t.i, t.category, n.name FROM names n JOIN (VALUES {FRAGMENT_SQL}) t(i, category, part) ON contains(n.name, t.part)"


@query(
    "q07_feature_report",
    with_clause(
        f"""{LONG_SQL},
names AS (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM f) ON COLUMNS(*) INTO NAME name VALUE missing),
kinds AS (UNPIVOT (SELECT typeof(COLUMNS(*)) FROM f LIMIT 1) ON COLUMNS(*) INTO NAME name VALUE kind),
groups AS ({GROUP_SQL})""",
        """SELECT n.name AS column_name, n.missing, CASE WHEN k.kind = 'DOUBLE' THEN 'double' WHEN k.kind = 'DATE' THEN 'date' WHEN k.kind = 'VARCHAR' THEN 'string' ELSE 'bigint' END AS data_type,
                  coalesce(string_agg(g.category, ',' ORDER BY g.i), '') AS categories
           FROM names n JOIN kinds k USING (name) LEFT JOIN groups g USING (name) GROUP BY ALL""",
    ),
)
def q07(spark, sf):
    return summaries.feature_report(feature_frame(spark, sf)[0])


@query(
    "q08_importance_report",
    with_clause(CORRELATION_SQL, f"SELECT {CLASSES_SQL}, count(*) FILTER (WHERE correlation > 0.5) > 0 AS use_strong_features, count(*) FILTER (WHERE correlation < 0.05) > 10 AS drop_weak_features FROM c"),
)
def q08(spark, sf):
    return summaries.importance_report(relevance.correlations(*feature_frame(spark, sf)))


@query(
    "q09_location_overview",
    with_views(
        f"""SELECT location, count(*) AS total_records, strftime(min(ds), '%Y-%m-%d') AS start_date, strftime(max(ds), '%Y-%m-%d') AS end_date,
                   {q6('round(avg(y), 2)', 'avg_daily_admissions')} FROM series GROUP BY location ORDER BY location""",
        "series",
    ),
)
def q09(spark, sf):
    return rounded(summaries.location_overview(tables.series(spark, sf)).orderBy("location"))


@query(
    "q10_forecast_lookup",
    with_views(f"SELECT location, ds, {q6('yhat')}, model FROM forecasts WHERE location = 'ASIA' AND model = 'ar1_diff0' AND step <= 10 ORDER BY ds", "forecasts"),
)
def q10(spark, sf):
    found = summaries.forecast_lookup(all_forecasts(spark, sf), "ASIA", "ar1_diff0", 10, ("historical_average", "ar1_diff0"))
    return rounded(found.select("location", "ds", "yhat", "model"))


@query(
    "q11_metrics_lookup",
    with_views(
        f"""SELECT model, location, {q6('mae')}, {q6('mape')}, {q6('accuracy')}, first_value(model) OVER (PARTITION BY location ORDER BY accuracy DESC, model) AS best_model FROM scores""",
        "scores",
    ),
)
def q11(spark, sf):
    found = summaries.metrics_lookup(holdout_scores(spark, sf))
    return rounded(found.select("model", "location", "mae", "mape", "accuracy", "best_model"))


@query(
    "q12_accuracy_comparison",
    with_views(
        f"""SELECT a.location, {q6('a.accuracy', 'historical_average')}, {q6('b.accuracy', 'ar1_diff0')},
                   CASE WHEN b.accuracy > a.accuracy THEN 'ar1_diff0' WHEN a.accuracy > b.accuracy THEN 'historical_average' END AS winner
            FROM mean_scores a JOIN ar_scores b ON a.location = b.location""",
        "mean_scores",
        "ar_scores",
    ),
)
def q12(spark, sf):
    scores = holdout_scores(spark, sf)
    sides = [scores.filter(F.col("model") == m) for m in ("historical_average", "ar1_diff0")]
    return rounded(summaries.accuracy_comparison(*sides, ("historical_average", "ar1_diff0")))


@query(
    "q13_key_figures",
    with_views(
        f"""SELECT count(DISTINCT model) AS models, {q6('avg(accuracy)', 'avg_accuracy')}, (SELECT count(DISTINCT location) FROM series) AS locations,
                   (SELECT count(*) FROM series) AS records FROM scores""",
        "scores",
    ),
)
def q13(spark, sf):
    return rounded(summaries.key_figures(tables.series(spark, sf), holdout_scores(spark, sf)))


@query("q11_tournament")
def q11_tournament(spark, sf):
    """Measures of every family and series, with the best of the series."""
    return rounded(summaries.metrics_lookup(tournament_scores(spark, sf)).select("model", "location", "mae", "mape", "accuracy", "best_model"))


@query("q12_tournament")
def q12_tournament(spark, sf):
    return rounded(tournament.accuracy_table(tournament_scores(spark, sf)))


@query("q13_tournament")
def q13_tournament(spark, sf):
    return rounded(summaries.key_figures(tables.series(spark, sf), tournament_scores(spark, sf)))


@query(
    "q14_alert_level",
    with_views(
        f"""SELECT f.location, f.ds, {q6('f.yhat', 'yhat')}, b.icu_beds, CASE WHEN f.yhat / b.icu_beds < 0.7 THEN 'low' WHEN f.yhat / b.icu_beds < 0.9 THEN 'medium' ELSE 'high' END AS alert_level
            FROM mean_forecast f JOIN (SELECT location, icu_beds // 8 AS icu_beds FROM beds) b ON f.location = b.location""",
        "mean_forecast",
        "beds",
    ),
)
def q14(spark, sf):
    beds = tables.supplier_beds(spark, sf).select("location", F.floor(F.col("icu_beds") / 8).alias("icu_beds"))
    joined = baseline.mean_forecast(tables.series(spark, sf)).join(beds, "location")
    level = summaries.alert_level(F.col("yhat"), F.col("icu_beds"))
    return rounded(joined.select("location", "ds", "yhat", "icu_beds", level.alias("alert_level")))


@query("q15_capacity_table", with_views("SELECT * FROM capacity", "capacity"))
def q15(spark, sf):
    return rounded(tables.day_capacity(spark, sf))


@query(
    "q16_training_summary",
    with_views(
        f"""SELECT s.model, s.location, count(*) OVER m AS models_trained, {q6('avg(s.accuracy) OVER m', 'average_accuracy')}, {q6('avg(s.mape) OVER m', 'average_mape')},
                   f.a AS forecasts_generated, f.b AS forecast_horizon
            FROM scores s LEFT JOIN (SELECT model, count(DISTINCT location) AS a, count(DISTINCT ds) AS b FROM forecasts GROUP BY model) f ON s.model = f.model
            WINDOW m AS (PARTITION BY s.model)""",
        "scores",
        "forecasts",
    ),
)
def q16(spark, sf):
    return rounded(summaries.training_summary(holdout_scores(spark, sf), all_forecasts(spark, sf)))


@query("q16_tournament")
def q16_tournament(spark, sf):
    return rounded(summaries.training_summary(tournament_scores(spark, sf), tournament.forecasts(tables.series(spark, sf))))


@query(
    "s06_feature_groups",
    with_clause(
        f"{LONG_SQL},\nnames AS (SELECT feature AS name, count(x) AS n FROM long GROUP BY feature),\ngroups AS ({GROUP_SQL})",
        "SELECT g.category, n.name AS feature, n.n AS n_values FROM names n JOIN groups g USING (name)",
    ),
)
def s06(spark, sf):
    """Feature groups by name, with the values each member holds."""
    frame, names = feature_frame(spark, sf)
    counts = summaries.null_counts(frame.select(*[named(c) for c in names])).withColumnRenamed("column_name", "feature")
    groups = spark.createDataFrame(categorise(names), "category string, feature string")
    total = frame.agg(F.count("*")).scalar()
    return groups.join(counts, "feature").select("category", "feature", (total - F.col("missing")).alias("n_values"))
