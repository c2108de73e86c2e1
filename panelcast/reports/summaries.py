"""Report tables: collection, quality, patterns, backtests, features and look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import iso_text
from ..operators.features import CATEGORY_FRAGMENTS, categorise
from ..operators.keys import as_list, named
from ..operators.relevance import correlation_classes

Key = str | Sequence[str]

# Error bands of the findings and the two advice limits.
EXCELLENT, GOOD, ACCEPTABLE = 10.0, 15.0, 20.0
WEAK_DIRECTION = 50.0

# Occupancy limits of the alert levels.
ALERT_MEDIUM, ALERT_HIGH = 0.7, 0.9


def domain_listing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (column_name, value) rows.

    One pass: every row is unrolled into its pairs and deduplicated before the
    shuffle. The list stays a table, however long it gets.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("_p")).select("_p.*").distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    listing = domain_listing(df, columns).filter(F.col("value").isNotNull())
    return listing.groupBy("column_name").agg(F.count("*").alias("n"))


def collection_summary(admissions: DataFrame, capacity: DataFrame) -> DataFrame:
    """One row over both fact tables; ``domain_listing`` has the names behind the counts."""
    left = admissions.agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_distinct("date").alias("days"),
        F.count_distinct("location").alias("locations"),
        F.count_distinct("disease_type").alias("diseases"),
        F.count_distinct("age_group").alias("age_groups"),
        F.count("*").alias("admission_records"),
        F.avg("admission_count").alias("avg_daily_admissions"),
        F.max("admission_count").alias("max_daily_admissions"),
        F.sum("admission_count").alias("total_admissions"),
    )
    right = capacity.agg(
        F.struct(F.count("*").alias("n"), F.avg("total_beds").alias("total"), F.avg("icu_beds").alias("icu"))
    ).scalar()
    wide = left.withColumn("_c", right)
    return wide.withColumns(
        {
            "capacity_records": F.col("_c.n"),
            "total_records": F.col("admission_records") + F.col("_c.n"),
            "avg_total_beds": F.col("_c.total"),
            "avg_icu_beds": F.col("_c.icu"),
        }
    ).drop("_c")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column in one pass, in long form."""
    columns = df.columns if columns is None else list(columns)
    wide = df.agg(*[F.count_if(named(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), named(c).alias("missing")) for c in columns])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def value_statistics(df: DataFrame, value: str = "admission_count") -> DataFrame:
    """Overall statistics in one aggregate.

    The exact median keeps one entry per distinct value, on both sides of the
    shuffle; for counts that is far below the number of rows.
    """
    return df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("std_value"),
        F.median(value).alias("median_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def location_statistics(df: DataFrame, key: Key = "location", value: str = "admission_count") -> DataFrame:
    return df.groupBy(*as_list(key)).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value")
    )


def data_quality(df: DataFrame, value: str = "admission_count", date: str = "date", key: str = "location") -> DataFrame:
    """Range, statistics and nulls of a panel in one row; nulls as a map."""
    columns = df.columns
    missing = F.create_map(*[part for c in columns for part in (F.lit(c), F.count_if(named(c).isNull()))])
    return df.agg(
        F.count("*").alias("total_records"),
        iso_text(F.min(date)).alias("start_date"),
        iso_text(F.max(date)).alias("end_date"),
        F.datediff(F.max(date), F.min(date)).alias("days"),
        F.count_distinct(key).alias("locations"),
        F.to_json(missing).alias("missing_values"),
        F.avg(value).alias("mean_daily_admissions"),
        F.stddev_samp(value).alias("std_daily_admissions"),
        F.min(value).alias("min_admissions"),
        F.max(value).alias("max_admissions"),
        F.median(value).alias("median_daily_admissions"),
    )


def location_overview(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    return series.groupBy(*as_list(key)).agg(
        F.count("*").alias("total_records"),
        iso_text(F.min(ds)).alias("start_date"),
        iso_text(F.max(ds)).alias("end_date"),
        F.round(F.avg(y), 2).alias("avg_daily_admissions"),
    )


def seasonal_means(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Means by month and by weekday from one pass with two grouping sets."""
    keys = [F.col(k) for k in as_list(key)]
    parts = series.select(*keys, F.month(ds).alias("month"), F.weekday(ds).alias("day_of_week"), F.col(y))
    month, weekday = F.col("month"), F.col("day_of_week")
    return parts.groupingSets([[*keys, month], [*keys, weekday]], *keys, month, weekday).agg(F.avg(y).alias("mean_y"))


def history_pattern(series: DataFrame, key: Key = "location", ds: str = "ds", y: str = "y") -> DataFrame:
    """Level, spread, linear trend and peak months per series.

    The series is shuffled once: months are a second aggregate over twelve
    rows per series, and the trend needs the row position only.
    """
    keys = as_list(key)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(ds)) - 1
    base = series.withColumn("_r", position).groupBy(*keys).agg(
        F.count("*").alias("total_records"),
        F.min(ds).alias("start_date"),
        F.max(ds).alias("end_date"),
        F.avg(y).alias("mean_y"),
        F.stddev_samp(y).alias("std_y"),
        F.min(y).alias("min_y"),
        F.max(y).alias("max_y"),
        F.regr_slope(F.col(y), F.col("_r")).alias("slope"),
    )
    months = series.groupBy(*keys, F.month(ds).alias("_m")).agg(F.avg(y).alias("_v"))
    peaks = months.groupBy(*keys).agg(
        F.max_by("_m", F.struct("_v", -F.col("_m"))).alias("peak_month"),
        F.min_by("_m", F.struct("_v", F.col("_m"))).alias("trough_month"),
    )
    direction = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    spread = F.when(F.col("mean_y") != 0, F.col("std_y") / F.when(F.col("mean_y") != 0, F.col("mean_y")) * 100)
    return base.join(peaks, keys).withColumns({"volatility": spread, "trend_direction": direction})


def overall_performance(cv: DataFrame, rolling: DataFrame, key: Key = "location") -> DataFrame:
    """Both validation errors per series and their mean, all in percent."""
    keys = as_list(key)
    both = cv.select(*keys, F.col("mape").alias("cv_mape")).join(
        rolling.select(*keys, F.col("mape").alias("rolling_mape"), "directional_accuracy", "total_predictions"), keys
    )
    return both.withColumn("avg_mape", (F.col("cv_mape") + F.col("rolling_mape")) / 2)


def backtest_summary(overall: DataFrame, key: str = "location") -> DataFrame:
    spread = [f(c).alias(f"{n}_{c}") for c in ("cv_mape", "rolling_mape") for n, f in (("avg", F.avg), ("best", F.min), ("worst", F.max))]
    return overall.agg(
        F.count("*").alias("total_locations"),
        *spread,
        F.avg("directional_accuracy").alias("avg_directional_accuracy"),
        F.min_by(key, F.struct("avg_mape", key)).alias("best_performing_location"),
        F.max_by(key, F.struct("avg_mape", key)).alias("worst_performing_location"),
    )


def error_band(mape: Column) -> Column:
    return (
        F.when(mape < EXCELLENT, "excellent")
        .when(mape < GOOD, "good")
        .when(mape < ACCEPTABLE, "acceptable")
        .otherwise("needs improvement")
    )


def findings(overall: DataFrame, summary: DataFrame, key: str = "location") -> DataFrame:
    """Finding texts as rows: overall band, series at the extremes, advice."""
    cv, direction = F.col("avg_cv_mape"), F.col("avg_directional_accuracy")
    advice = F.array_compact(
        F.array(
            F.concat(F.lit("overall: "), error_band(cv)),
            F.when(cv > ACCEPTABLE, "advice: tune features or model"),
            F.when(direction < WEAK_DIRECTION, "advice: improve trend analysis"),
        )
    )
    general = summary.select(F.lit(None).cast("string").alias(key), F.explode(advice).alias("finding"))
    mape = F.col("avg_mape")
    own = F.when(mape < EXCELLENT, "excellent").when(mape > ACCEPTABLE, "needs improvement")
    return general.unionByName(overall.select(key, own.alias("finding")).filter(F.col("finding").isNotNull()))


def feature_report(df: DataFrame, fragments: Mapping[str, Sequence[str]] = CATEGORY_FRAGMENTS) -> DataFrame:
    """Every column with its type, nulls and feature groups. Groups come from the schema alone."""
    kinds = dict(df.dtypes)
    groups: dict[str, list[str]] = {}
    for group, name in categorise(df.columns, fragments):
        groups.setdefault(name, []).append(group)
    meta = F.create_map(*[p for c in df.columns for p in (F.lit(c), F.struct(F.lit(kinds[c]).alias("data_type"), F.lit(",".join(groups.get(c, []))).alias("categories")))])
    nulls = null_counts(df).withColumn("_m", F.element_at(meta, F.col("column_name")))
    return nulls.select("column_name", "missing", "_m.data_type", "_m.categories")


def importance_report(scores: DataFrame) -> DataFrame:
    """Correlation classes with the two recommendations as flags."""
    classes = correlation_classes(scores)
    return classes.withColumns(
        {"use_strong_features": F.col("very_highly_correlated") > 0, "drop_weak_features": F.col("negligible") > 10}
    )


def forecast_lookup(forecasts: DataFrame, location: str, model: str, days: int, models: Sequence[str], max_days: int = 90) -> DataFrame:
    """First days of one series' forecast, after checking the request."""
    if not 1 <= days <= max_days:
        raise ValueError(f"days must lie between 1 and {max_days}")
    if model not in models:
        raise ValueError(f"unknown model {model!r}; choose one of {sorted(models)}")
    rows = forecasts.filter((F.col("location") == location) & (F.col("model") == model))
    return rows.orderBy("ds").limit(days)


def metrics_lookup(metrics: DataFrame, model: str | None = None) -> DataFrame:
    """Metrics of one model or all, with the preferred model per series.

    The first name in alphabetical order is preferred among equal accuracies.
    """
    w = Window.partitionBy("location").orderBy(F.desc("accuracy"), "model")
    out = metrics.withColumn("best_model", F.first("model").over(w))
    return out if model is None else out.filter(F.col("model") == model)


def accuracy_comparison(left: DataFrame, right: DataFrame, names: tuple[str, str], key: str = "location") -> DataFrame:
    """Accuracies of two models side by side, zero where missing, and the winner."""
    a, b = names
    both = left.select(key, F.col("accuracy").alias(a)).join(right.select(key, F.col("accuracy").alias(b)), key, "full")
    filled = both.withColumns({a: F.coalesce(a, F.lit(0.0)), b: F.coalesce(b, F.lit(0.0))})
    return filled.withColumn("winner", F.when(F.col(b) > F.col(a), b).when(F.col(a) > F.col(b), a))


def key_figures(series: DataFrame, metrics: DataFrame, key: str = "location") -> DataFrame:
    """Models, series, mean accuracy and records in one row."""
    row = metrics.agg(F.count_distinct("model").alias("models"), F.avg("accuracy").alias("avg_accuracy"))
    counts = series.agg(F.struct(F.count_distinct(key).alias("k"), F.count("*").alias("n"))).scalar()
    return row.withColumn("_c", counts).withColumns({"locations": F.col("_c.k"), "records": F.col("_c.n")}).drop("_c")


def alert_level(usage: Column, capacity: Column) -> Column:
    share = F.when(capacity > 0, usage / F.when(capacity > 0, capacity))
    return F.when(share < ALERT_MEDIUM, "low").when(share < ALERT_HIGH, "medium").otherwise("high")


def training_summary(metrics: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Series trained, forecasts made, mean accuracy and error, horizon.

    One row per model and trained series, the model's figures repeated, so the
    list of series is rows instead of one long cell.
    """
    trained = metrics.groupBy("model").agg(
        F.count("*").alias("models_trained"), F.avg("accuracy").alias("average_accuracy"), F.avg("mape").alias("average_mape")
    )
    made = forecasts.groupBy("model").agg(
        F.count_distinct("location").alias("forecasts_generated"), F.count_distinct("ds").alias("forecast_horizon")
    )
    return metrics.select("model", "location").join(trained.join(made, "model", "left"), "model")
