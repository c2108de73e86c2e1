"""Scan and sink queries (IO): each writes to shared scratch space and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import baseline, folds
from ..operators import features, panel
from ..reports import summaries
from ..sources import files, tables
from .joins import all_forecasts, holdout_scores
from .registry import q6, query, rounded
from .views import with_views

EPISODE_SCHEMA = "date date, location string, disease_type string, age double, order_id long"
SERIES_SCHEMA = "location string, ds date, y int, is_weekend int, month int, disease_severity double"
SERIES_SQL = f"SELECT location, ds, y, is_weekend, month, {q6('disease_severity')} FROM series"


@query("io01_csv_scan", with_views(f"SELECT date, location, disease_type, {q6('age')}, order_id FROM episodes", "episodes"))
def io01(spark, sf):
    path = files.workspace(spark, "episodes")
    files.write_csv(tables.episodes(spark, sf), path)
    return rounded(files.read_csv(spark, path, EPISODE_SCHEMA))


@query("io02_series_csv", with_views(SERIES_SQL, "series"))
def io02(spark, sf):
    """Series file read back; a missing file adds no rows."""
    path = files.workspace(spark, "series")
    files.write_csv(tables.series(spark, sf), path)
    missing = files.read_series(spark, f"{path}-missing", SERIES_SCHEMA)
    return rounded(files.read_series(spark, path, SERIES_SCHEMA).unionByName(missing))


@query("io03_fallback_path", with_views(SERIES_SQL, "series"))
def io03(spark, sf):
    path = files.workspace(spark, "series")
    files.replace_table(tables.series(spark, sf), f"{path}/combined")
    return rounded(spark.read.parquet(files.first_existing(spark, f"{path}/enhanced", f"{path}/combined")))


@query(
    "io04_ordered_scan",
    with_views("SELECT date, location, disease_type, age_group, admission_count FROM admissions ORDER BY date, location, disease_type, age_group", "admissions"),
)
def io04(spark, sf):
    path = files.workspace(spark, "admissions")
    files.replace_table(tables.admissions(spark, sf).drop("disease_severity"), path)
    return spark.read.parquet(path).select("date", "location", "disease_type", "age_group", "admission_count").orderBy(
        "date", "location", "disease_type", "age_group"
    )


@query("io05_day_value_frame", with_views("SELECT location, ds, y FROM series", "series"))
def io05(spark, sf):
    return rounded(tables.series(spark, sf).select("location", "ds", "y"))


@query("io06_clustered_load", with_views("SELECT location, ds, y FROM series", "series"))
def io06(spark, sf):
    """Rows of a series together and in order, without a global sort."""
    return rounded(tables.series(spark, sf).select("location", "ds", "y").repartition("location").sortWithinPartitions("location", "ds"))


@query(
    "io07_forecast_folder",
    with_views(
        f"SELECT upper(substr(location, 1, 1)) || lower(substr(location, 2)) AS location, ds, {q6('yhat')} FROM mean_forecast", "mean_forecast"
    ).replace("upper(substr(location, 1, 1)) || lower(substr(location, 2))", "CASE location WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(substr(location, 1, 1)) || lower(substr(location, 2)) END"),
)
def io07(spark, sf):
    folder = files.workspace(spark, "forecasts")
    files.write_slugged(baseline.mean_forecast(tables.series(spark, sf)).select("location", "ds", "yhat"), folder)
    return rounded(files.read_forecast_folder(spark, folder, "ds date, yhat double").select("location", "ds", "yhat"))


@query(
    "io08_metrics_json",
    with_views(
        " UNION ALL ".join(f"SELECT location, '{c}' AS metric, {q6(c, 'value')} FROM mean_scores" for c in ("mae", "mape", "accuracy")), "mean_scores"
    ),
)
def io08(spark, sf):
    """One document ``{location: {metric: value}}``, written and read."""
    path = files.workspace(spark, "metrics")
    scores = holdout_scores(spark, sf).filter(F.col("model") == "historical_average")
    files.write_metrics(scores, path, ["mae", "mape", "accuracy"])
    return rounded(files.read_metrics(spark, path))


@query(
    "io09_wide_csv",
    "SELECT CAST(l_shipdate AS DATE) AS ds, count(*) AS total FROM lineitem GROUP BY ALL",
)
def io09(spark, sf):
    """Table with a column per day of all days, read from the second of two paths."""
    lines = tables.table(spark, sf, "lineitem").groupBy("l_linestatus", F.to_date("l_shipdate").alias("ds")).agg(F.count("*").alias("n"))
    counts, ids, path = files.checkpointed(lines, "days"), ["l_linestatus"], files.workspace(spark, "wide")
    days = panel.day_positions(counts)
    files.write_wide(panel.wide_by_day(counts, ids, "n", days), days, path, ids)
    wide, named_days = files.read_wide(spark, [f"{path}-remote", path], ids)
    return panel.column_sums(wide, named_days, "total")


@query("io10_replace_table", with_views("SELECT date, location, disease_type, age_group, admission_count FROM admissions", "admissions"))
def io10(spark, sf):
    """Written twice: the second write replaces the first."""
    path = files.workspace(spark, "table")
    rows = tables.admissions(spark, sf).drop("disease_severity")
    files.replace_table(rows.filter(F.col("location") == "ASIA"), path)
    files.replace_table(rows, path)
    return spark.read.parquet(path)


@query("io11_partitioned_series", with_views(f"SELECT location, ds, y FROM series WHERE location IN ('ASIA', 'EUROPE')", "series"))
def io11(spark, sf):
    """One folder per series, then two of them read without listing the others."""
    path = files.workspace(spark, "by-location")
    files.write_by(tables.series(spark, sf), path, "location")
    rows = files.read_partition(spark, path, location="ASIA").unionByName(files.read_partition(spark, path, location="EUROPE"))
    return rounded(rows.select("location", "ds", "y"))


@query("io12_forecast_sink", with_views(f"SELECT model, location, ds, {q6('yhat')} FROM forecasts", "forecasts"))
def io12(spark, sf):
    path = files.workspace(spark, "forecasts")
    files.write_by(all_forecasts(spark, sf), path, "model", "location")
    return rounded(spark.read.parquet(path).select("model", "location", "ds", "yhat"))


@query(
    "io13_feature_sink",
    with_views(f"SELECT location, ds, y, is_weekend, month, {q6('disease_severity')} FROM cities", "cities"),
)
def io13(spark, sf):
    """The feature frame and its report, written and read back."""
    path = files.workspace(spark, "features")
    files.replace_table(features.all_features(tables.city_series(spark, sf)), f"{path}/frame")
    saved = spark.read.parquet(f"{path}/frame")
    files.write_json(summaries.feature_report(saved), f"{path}/report")
    return rounded(saved.select("location", "ds", "y", "is_weekend", "month", "disease_severity"))


@query("io14_report_sink", with_views(f"SELECT location, {q6('cv_mape')}, {q6('rolling_mape')}, {q6('avg_mape')} FROM overall", "overall"))
def io14(spark, sf):
    from .reports import overall_performance

    path = files.workspace(spark, "backtest")
    files.write_json(overall_performance(spark, sf), path)
    saved = spark.read.schema("location string, cv_mape double, rolling_mape double, avg_mape double").json(path)
    return rounded(saved)


DETAILED_SQL = " UNION ALL ".join(
    f"SELECT location, cutoff, ds, CAST(step AS BIGINT) AS step, actual, '{m}' AS model, {q6(c, 'yhat')} FROM origin" for m, c in (("historical_average", "yhat_mean"), ("autoregression", "yhat_ar"))
)


@query(
    "io14_backtest_pair",
    with_views(
        f"""SELECT d.*, {q6('o.cv_mape', 'cv_mape')}, {q6('o.rolling_mape', 'rolling_mape')}, {q6('o.avg_mape', 'avg_mape')}
            FROM ({DETAILED_SQL}) d JOIN overall o USING (location)""",
        "origin",
        "overall",
    ),
)
def io14_pair(spark, sf):
    """Dated predictions and the summary, committed together, replaced once and read as one."""
    from .reports import overall_performance

    folder = files.workspace(spark, "backtest")
    made = folds.rolling_origin(tables.series(spark, sf), **folds.CV)
    long = made.unpivot(["location", "cutoff", "ds", "step", "actual"], ["yhat_mean", "yhat_ar"], "model", "yhat")
    long = long.withColumn("model", F.when(F.col("model") == "yhat_mean", "historical_average").otherwise("autoregression"))
    summary = overall_performance(spark, sf).select("location", "cv_mape", "rolling_mape", "avg_mape")
    files.write_pair(long.limit(0), summary.limit(0), folder)
    files.write_pair(long, summary, folder)
    detailed, totals = files.read_pair(spark, folder)
    return rounded(detailed.join(totals, "location"))
