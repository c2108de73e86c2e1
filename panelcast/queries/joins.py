"""Join queries (J) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import autoregressive, baseline, ensemble, folds
from ..operators import holidays, panel, places
from ..reports import summaries
from ..sources import tables
from .registry import q6, query, rounded
from .views import with_views


def all_forecasts(spark, sf):
    """Forecasts of the average, the autoregression and the repeated last value."""
    series = tables.series(spark, sf)
    return (
        baseline.mean_forecast(series)
        .unionByName(autoregressive.autoregressive_forecast(series))
        .unionByName(autoregressive.autoregressive_forecast(series, order=(0, 1)))
    )


def holdout_scores(spark, sf):
    """Hold-out measures of the average and the autoregression, by model and series."""
    series = tables.series(spark, sf)
    mean = baseline.holdout_forecast(series).withColumn("model", F.lit("historical_average"))
    ar = autoregressive.holdout_forecast(series).withColumn("model", F.lit("ar1_diff0"))
    return folds.error_table(mean.unionByName(ar), ["model", "location"])


@query("j01_calendar_join", with_views(f"SELECT location, ds, y, {q6('disease_severity')} FROM gapped", "gapped"))
def j01(spark, sf):
    return rounded(panel.calendar_join(tables.daily(spark, sf)))


@query(
    "j02_dimension_join",
    with_views(
        f"""SELECT d.location, d.ds, d.y, coalesce(b.total_beds, 300) AS total_beds, coalesce(b.icu_beds, 30) AS icu_beds,
                   {q6('d.y / coalesce(b.total_beds, 300)', 'occupancy')} FROM daily d LEFT JOIN (SELECT * FROM beds WHERE location <> 'ASIA') b ON d.location = b.location""",
        "daily",
        "beds",
    ),
)
def j02(spark, sf):
    beds = tables.supplier_beds(spark, sf).filter(F.col("location") != "ASIA")
    joined = places.dimension_join(tables.daily(spark, sf), beds, "location", {"total_beds": 300, "icu_beds": 30})
    return rounded(joined.withColumn("occupancy", F.col("y") / F.col("total_beds")).select("location", "ds", "y", "total_beds", "icu_beds", "occupancy"))


@query(
    "j03_location_dates",
    with_views("SELECT l.location, d.date FROM (SELECT DISTINCT location FROM episodes) l CROSS JOIN (SELECT DISTINCT date FROM episodes) d", "episodes"),
)
def j03(spark, sf):
    return panel.location_date_skeleton(tables.admissions(spark, sf))


@query(
    "j04_membership",
    with_views(
        """SELECT location, ds, y, CASE WHEN ds IN (SELECT h FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
                  CASE WHEN location IN ('Da Nang', 'Ho Chi Minh City') THEN 1 ELSE 0 END AS is_tourism_city FROM cities""",
        "cities",
        "holidays",
    ),
)
def j04(spark, sf):
    marked = holidays.is_member(tables.city_series(spark, sf), holidays.holiday_table(spark), "is_holiday")
    group = places.group_columns(F.col("location"))["is_tourism_city"]
    return rounded(marked.select("location", "ds", "y", "is_holiday", group.alias("is_tourism_city")))


NEARBY_SQL = """CAST(EXISTS (SELECT 1 FROM holidays WHERE h > c.ds AND h <= c.ds + 3) AS BIGINT) AS pre_holiday,
  CAST(EXISTS (SELECT 1 FROM holidays WHERE h < c.ds AND h >= c.ds - 3) AS BIGINT) AS post_holiday,
  CAST(EXISTS (SELECT 1 FROM holidays WHERE h = c.ds) AS BIGINT) AS on_holiday"""
SEASON_SQL = "CAST(EXISTS (SELECT 1 FROM holidays WHERE holiday = 'tet' AND c.ds BETWEEN h - 14 AND h + 7) AS BIGINT) AS is_tet_season"


@query("j05_range_join", with_views(f"SELECT location, ds, {NEARBY_SQL} FROM cities c", "cities", "holidays"))
def j05(spark, sf):
    days = tables.city_series(spark, sf).select("location", "ds")
    return rounded(holidays.attach_by_day(days, holidays.nearby_by_day(holidays.holiday_table(spark))).select("location", "ds", "pre_holiday", "post_holiday", "on_holiday"))


@query("j06_interval_join", with_views(f"SELECT location, ds, {SEASON_SQL} FROM cities c", "cities", "holidays"))
def j06(spark, sf):
    days = tables.city_series(spark, sf).select("location", "ds")
    return rounded(holidays.attach_by_day(days, holidays.season_by_day(holidays.holiday_table(spark))).select("location", "ds", "is_tet_season"))


@query(
    "j07_align_forecasts",
    with_views(
        f"""SELECT location, ds, {q6("max(CASE WHEN model = 'historical_average' THEN yhat END)", 'historical_average')},
                   {q6("max(CASE WHEN model = 'ar1_diff0' THEN yhat END)", 'ar1_diff0')} FROM forecasts GROUP BY location, ds""",
        "forecasts",
    ),
)
def j07(spark, sf):
    return rounded(ensemble.align_forecasts(all_forecasts(spark, sf), ["historical_average", "ar1_diff0"]))


@query(
    "j08_full_outer_metrics",
    with_views(
        f"""SELECT coalesce(a.location, b.location) AS location, {q6('coalesce(a.accuracy, 0)', 'historical_average')}, {q6('coalesce(b.accuracy, 0)', 'ar1_diff0')}
            FROM (SELECT * FROM mean_scores WHERE location <> 'ASIA') a FULL JOIN (SELECT * FROM ar_scores WHERE location <> 'EUROPE') b ON a.location = b.location""",
        "mean_scores",
        "ar_scores",
    ),
)
def j08(spark, sf):
    scores = holdout_scores(spark, sf)
    left = scores.filter((F.col("model") == "historical_average") & (F.col("location") != "ASIA"))
    right = scores.filter((F.col("model") == "ar1_diff0") & (F.col("location") != "EUROPE"))
    return rounded(summaries.accuracy_comparison(left, right, ("historical_average", "ar1_diff0")).drop("winner"))


@query(
    "j09_actual_predicted",
    with_views(f"SELECT location, ds, actual, {q6('yhat')} FROM mean_test", "mean_test"),
)
def j09(spark, sf):
    return rounded(baseline.holdout_forecast(tables.series(spark, sf)))


@query(
    "j10_fold_join",
    with_views(
        """SELECT s.location, f.cutoff, count(*) FILTER (WHERE s.ds <= f.cutoff) AS train_rows, count(*) FILTER (WHERE s.ds > f.cutoff) AS test_rows
           FROM series s JOIN (SELECT location, max(ds) - 14 - unnest(range(0, date_diff('day', min(ds), max(ds)) - 194 + 1, 30))::INTEGER AS cutoff FROM series GROUP BY location) f
             ON s.location = f.location AND s.ds <= f.cutoff + 14 GROUP BY s.location, f.cutoff""",
        "series",
    ),
)
def j10(spark, sf):
    return folds.fold_sizes(tables.series(spark, sf).select("location", "ds"), **folds.CV)


@query(
    "u01_union_frames",
    with_views(f"SELECT location, ds, {q6('yhat')}, model FROM forecasts", "forecasts"),
)
def u01(spark, sf):
    return rounded(all_forecasts(spark, sf).select("location", "ds", "yhat", "model"))


@query(
    "u02_distinct_names",
    with_views("SELECT location AS name FROM mean_scores UNION SELECT location FROM forecasts UNION SELECT model FROM forecasts", "mean_scores", "forecasts"),
)
def u02(spark, sf):
    scores, made = holdout_scores(spark, sf), all_forecasts(spark, sf)
    names = scores.select(F.col("location").alias("name")).union(made.select("location")).union(made.select("model"))
    return names.distinct()
