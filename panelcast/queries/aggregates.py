"""Aggregation queries (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..models import baseline, folds
from ..operators import clean, features, panel, relevance, windows
from ..reports import summaries
from ..sources import files, tables
from .calendar import FULL_SQL
from .joins import holdout_scores
from .registry import q6, query, rounded
from .views import backtest_sql, with_views

# The whole feature frame in long form: location, ds, y, feature, x.
LONG_SQL = f"""f AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY population_category) - 1 AS population_category_code FROM ({FULL_SQL})),
long AS MATERIALIZED (UNPIVOT (SELECT location, ds, y, CAST(COLUMNS(* EXCLUDE (location, ds, y, population_category)) AS DOUBLE) FROM f)
  ON COLUMNS(* EXCLUDE (location, ds, y)) INTO NAME feature VALUE x)"""
CORRELATION = "CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0.0 ELSE coalesce(abs(corr(x, y)), 0.0) END"
CORRELATION_SQL = f"{LONG_SQL},\nc AS (SELECT feature, {CORRELATION} AS correlation FROM long GROUP BY feature)"
# the bin of a value: the share of smaller values in tenths; the target's over all rows
INFORMATION_SQL = f"""{LONG_SQL},
targets AS (SELECT location, ds, (rank() OVER (ORDER BY y) - 1) * 10 // count(*) OVER () AS by_ FROM f WHERE y IS NOT NULL),
cells AS (SELECT feature, (rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 // count(*) OVER (PARTITION BY feature) AS bx, by_ FROM long JOIN targets USING (location, ds)),
joint AS (SELECT feature, bx, by_, count(*) AS n FROM cells GROUP BY ALL),
shares AS (SELECT *, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, by_) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM joint),
mi AS (SELECT feature, sum(CAST(n AS DOUBLE) / nn * ln(CAST(n AS DOUBLE) * nn / (CAST(nx AS DOUBLE) * ny))) AS mutual_information FROM shares GROUP BY feature)"""


def with_clause(clause: str, body: str) -> str:
    return f"WITH {clause}\n{body}"


def feature_frame(spark, sf):
    """The whole feature frame to six decimals, labels coded, and the names of its inputs; written once."""
    frame = features.encode_labels(features.all_features(tables.city_series(spark, sf)), "population_category")
    frame = files.checkpointed(rounded(frame), "feature-frame")
    return frame, features.numeric_features(frame)


@query(
    "a01_count_records",
    with_views("SELECT date, location, disease_type, age_group, admission_count FROM admissions", "admissions"),
)
def a01(spark, sf):
    """Counted per customer before the customers are joined."""
    return tables.admissions(spark, sf).drop("disease_severity")


@query(
    "a02_daily_panel",
    with_views(
        f"""SELECT location, ds AS date, y AS admission_count, {q6('disease_severity')}, year(ds) AS year, month(ds) AS month, day(ds) AS day,
                   isodow(ds) - 1 AS day_of_week, dayofyear(ds) AS day_of_year, weekofyear(ds) AS week_of_year, quarter(ds) AS quarter,
                   CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend, 0 AS is_holiday, CAST(500000 AS BIGINT) AS population,
                   {q6('y / 500000 * 100000', 'admissions_per_100k')} FROM daily""",
        "daily",
    ),
)
def a02(spark, sf):
    return rounded(panel.daily_panel(tables.admissions(spark, sf)))


@query(
    "a03_dense_grouping",
    with_views(
        """SELECT l.location, d.date, t.disease_type, a.age_group, coalesce(x.admission_count, 0) AS admission_count
           FROM (SELECT DISTINCT location FROM grouped) l CROSS JOIN (SELECT DISTINCT date FROM grouped) d
           CROSS JOIN (SELECT DISTINCT disease_type FROM grouped) t
           CROSS JOIN (VALUES ('0-18'), ('19-30'), ('31-50'), ('51-65'), ('65+')) a(age_group)
           LEFT JOIN admissions x ON x.location = l.location AND x.date = d.date AND x.disease_type = t.disease_type AND x.age_group = a.age_group""",
        "admissions",
    ),
)
def a03(spark, sf):
    counts = files.checkpointed(tables.admissions(spark, sf).drop("disease_severity"), "counts")
    return panel.dense_grid(counts, ["location", "date", "disease_type", "age_group"], {"age_group": clean.AGE_LABELS})


@query(
    "a04_location_stats",
    with_views(
        f"""SELECT location, count(*) AS total_records, strftime(min(ds), '%Y-%m-%d') AS start_date, strftime(max(ds), '%Y-%m-%d') AS end_date,
                   {q6('round(avg(y), 2)', 'avg_daily_admissions')} FROM series GROUP BY location""",
        "series",
    ),
)
def a04(spark, sf):
    return rounded(summaries.location_overview(tables.series(spark, sf)))


@query(
    "a05_seasonal_means",
    with_views(
        f"""SELECT location, month(ds) AS month, NULL::BIGINT AS day_of_week, {q6('avg(y)', 'mean_y')} FROM series GROUP BY ALL
            UNION ALL SELECT location, NULL::BIGINT, isodow(ds) - 1, {q6('avg(y)', 'mean_y')} FROM series GROUP BY ALL""",
        "series",
    ),
)
def a05(spark, sf):
    return rounded(summaries.seasonal_means(tables.series(spark, sf)))


@query(
    "a06_statistics",
    with_views(
        f"""SELECT 'all' AS location, count(admission_count) AS n, {q6('avg(admission_count)', 'mean_value')}, {q6('stddev_samp(admission_count)', 'std_value')},
                   {q6('median(admission_count)', 'median_value')}, min(admission_count) AS min_value, max(admission_count) AS max_value FROM cleaned
            UNION ALL SELECT location, count(admission_count), {q6('avg(admission_count)', 'a')}, {q6('stddev_samp(admission_count)', 'b')}, NULL, NULL, NULL FROM cleaned GROUP BY location""",
        "cleaned",
    ),
)
def a06(spark, sf):
    panel_rows = clean.clean(tables.dirty_admissions(spark, sf))
    overall = summaries.value_statistics(panel_rows).withColumn("location", F.lit("all"))
    return rounded(overall.unionByName(summaries.location_statistics(panel_rows), allowMissingColumns=True)).select(
        "location", "n", "mean_value", "std_value", "median_value", "min_value", "max_value"
    )


@query(
    "a07_null_counts",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM dirty"
            for c in ("date", "location", "disease_type", "age_group", "admission_count")
        ),
        "dirty",
    ),
)
def a07(spark, sf):
    return summaries.null_counts(tables.dirty_admissions(spark, sf))


DOMAINS = ("location", "disease_type", "age_group")


@query(
    "a08_distinct_values",
    with_views(
        "SELECT v.*, count(*) OVER (PARTITION BY column_name) AS n FROM ("
        + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM admissions" for c in DOMAINS)
        + ") v",
        "admissions",
    ),
)
def a08(spark, sf):
    rows = tables.admissions(spark, sf)
    return summaries.domain_listing(rows, DOMAINS).join(summaries.distinct_counts(rows, DOMAINS), "column_name").orderBy("column_name", "value")


@query(
    "a09_totals",
    with_views(
        f"""SELECT sum_a AS total_admissions, {q6('avg_a', 'avg_daily_admissions')}, max_a AS max_daily_admissions, {q6('avg_t', 'avg_total_beds')}, {q6('avg_i', 'avg_icu_beds')}
            FROM (SELECT CAST(sum(admission_count) AS BIGINT) AS sum_a, avg(admission_count) AS avg_a, max(admission_count) AS max_a FROM admissions),
                 (SELECT avg(total_beds) AS avg_t, avg(icu_beds) AS avg_i FROM beds)""",
        "admissions",
        "beds",
    ),
)
def a09(spark, sf):
    row = summaries.collection_summary(tables.admissions(spark, sf), tables.supplier_beds(spark, sf))
    return rounded(row.select("total_admissions", "avg_daily_admissions", "max_daily_admissions", "avg_total_beds", "avg_icu_beds"))


@query("a10_correlation", with_clause(CORRELATION_SQL, f"SELECT feature, {q6('correlation')} FROM c ORDER BY correlation DESC"))
def a10(spark, sf):
    return rounded(relevance.correlations(*feature_frame(spark, sf))).orderBy(F.desc("correlation"))


@query("a11_mutual_information", with_clause(INFORMATION_SQL, f"SELECT feature, {q6('mutual_information')} FROM mi"))
def a11(spark, sf):
    return rounded(relevance.mutual_information(*feature_frame(spark, sf)))


CLASSES_SQL = """count(*) AS total_features, count(*) FILTER (WHERE correlation > 0.3) AS highly_correlated,
       count(*) FILTER (WHERE correlation > 0.1 AND correlation <= 0.3) AS moderately_correlated,
       count(*) FILTER (WHERE correlation <= 0.1) AS low_correlated,
       count(*) FILTER (WHERE correlation > 0.5) AS very_highly_correlated, count(*) FILTER (WHERE correlation < 0.05) AS negligible"""


@query("a12_correlation_classes", with_clause(CORRELATION_SQL, f"SELECT {CLASSES_SQL} FROM c"))
def a12(spark, sf):
    return relevance.correlation_classes(relevance.correlations(*feature_frame(spark, sf)))


@query("a13_trend_slope", with_views(f"SELECT location, {q6('regr_slope(y, r)', 'slope')} FROM positions GROUP BY location", "positions"))
def a13(spark, sf):
    rows = windows.row_trend(tables.series(spark, sf))
    return rounded(rows.groupBy("location").agg(F.regr_slope("y", "trend").alias("slope")))


@query(
    "a14_variation",
    with_views(f"SELECT location, {q6('stddev_samp(y) / avg(y) * 100', 'volatility')} FROM series GROUP BY location", "series"),
)
def a14(spark, sf):
    return rounded(summaries.history_pattern(tables.series(spark, sf)).select("location", "volatility"))


@query(
    "a15_peak_months",
    with_views(
        """SELECT location, arg_max(m, v * 1000 - m / 1000) AS peak_month, arg_min(m, v * 1000 + m / 1000) AS trough_month
           FROM (SELECT location, month AS m, avg(y) AS v FROM series GROUP BY ALL) GROUP BY location""",
        "series",
    ),
)
def a15(spark, sf):
    return rounded(summaries.history_pattern(tables.series(spark, sf)).select("location", "peak_month", "trough_month"))


SCORE_COLUMNS = ", ".join(q6(c) for c in ("mae", "mse", "rmse", "mape", "smape", "accuracy", "mean_actual", "mean_predicted"))


@query(
    "a16_error_metrics",
    with_views(
        f"""SELECT 'historical_average' AS model, location, {SCORE_COLUMNS}, non_zero_samples, test_days FROM mean_scores
            UNION ALL SELECT 'ar1_diff0', location, {SCORE_COLUMNS}, non_zero_samples, test_days FROM ar_scores""",
        "mean_scores",
        "ar_scores",
    ),
)
def a16(spark, sf):
    return rounded(holdout_scores(spark, sf))


@query(
    "a17_raw_mape",
    with_views(
        f"""SELECT location, {q6("avg(CASE WHEN a = 0 THEN CASE WHEN p = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE abs((a - p) / CAST(a AS DOUBLE)) END) * 100", 'mape')}
            FROM (SELECT location, y - CASE WHEN location = 'ASIA' THEN (SELECT min(y) FROM series) ELSE 0 END AS a, lag(y) OVER (PARTITION BY location ORDER BY ds) + 0.25 AS p FROM series)
            WHERE p IS NOT NULL GROUP BY location""",
        "series",
    ),
)
def a17(spark, sf):
    series = tables.series(spark, sf)
    lowest = series.agg(F.min("y")).scalar()
    lagged = windows.lag_columns(series, (1,)).filter(F.col("lag_1").isNotNull())
    pairs = lagged.withColumn("a", F.col("y") - F.when(F.col("location") == "ASIA", lowest).otherwise(0)).withColumn("p", F.col("lag_1") + 0.25)
    return rounded(pairs.groupBy("location").agg(metrics.mape_raw(F.col("a"), F.col("p")).alias("mape")))


@query(
    "a18_epsilon_mape",
    with_views(
        f"""SELECT location, {q6('avg(abs(actual - yhat) / greatest(abs(actual), 2.220446049250313e-16::DOUBLE)) * 100', 'mape')} FROM mean_test GROUP BY location""",
        "mean_test",
    ),
)
def a18(spark, sf):
    tests = baseline.holdout_forecast(tables.series(spark, sf))
    return rounded(tests.groupBy("location").agg(metrics.mape_epsilon(F.col("actual"), F.col("yhat")).alias("mape")))


@query(
    "a19_directional_accuracy",
    with_views(f"SELECT location, {q6('directional_accuracy')}, total_predictions FROM ({backtest_sql('rolling', 'yhat_ar')})", "rolling"),
)
def a19(spark, sf):
    scored = folds.rolling_backtest(tables.series(spark, sf), **folds.ROLLING)
    return rounded(folds.backtest_metrics(scored, "yhat_ar").select("location", "directional_accuracy", "total_predictions"))


@query(
    "a20_cv_metrics",
    with_views(
        "SELECT location, " + ", ".join(q6(c) for c in ("mae", "rmse", "mape", "mdape", "coverage")) + ", folds, horizons FROM cv_scores", "cv_scores"
    ),
)
def a20(spark, sf):
    return rounded(cv_scores(spark, sf))


def cv_scores(spark, sf):
    """Cross-validated measures of the autoregression, averaged over the forecast steps."""
    scored = folds.rolling_origin(tables.series(spark, sf), **folds.CV)
    yhat = F.col("yhat_ar")
    per_step = folds.horizon_metrics(scored, "yhat_ar", yhat * (1 - baseline.BAND_SHARE), yhat * (1 + baseline.BAND_SHARE))
    columns = ["location", "mae", "rmse", "mape", "mdape", "coverage", "folds", "horizons"]
    return folds.mean_over_horizons(per_step).select(*columns)


@query(
    "a21_wide_ratio",
    f"""SELECT ds, sum(total) AS total, sum(returned) AS returned, {q6('sum(returned) / sum(total)', 'return_rate')}
        FROM (SELECT CAST(l_shipdate AS DATE) AS ds, l_linestatus, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY ALL)
        GROUP BY ds""",
)
def a21(spark, sf):
    """Sums by day of two wide tables (one place per day) and their ratio."""
    lines = tables.table(spark, sf, "lineitem").withColumn("ds", F.to_date("l_shipdate"))
    counts = files.checkpointed(lines.groupBy("l_linestatus", "ds").agg(F.count("*").alias("all"), F.count_if(F.col("l_returnflag") == "R").alias("back")), "days")
    days = files.checkpointed(panel.day_positions(counts), "calendar")
    total = panel.column_sums(panel.wide_by_day(counts, ["l_linestatus"], "all", days), days, "total")
    returned = panel.column_sums(panel.wide_by_day(counts, ["l_linestatus"], "back", days), days, "returned")
    return rounded(panel.ratio_by_day(returned, total, "returned", "total", "return_rate").select("ds", "total", "returned", "return_rate"))
