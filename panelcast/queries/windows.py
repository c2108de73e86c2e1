"""Window queries (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, windows
from ..operators.keys import named
from ..sources import tables
from .registry import q6, query, rounded
from .views import with_views

ORDER = "PARTITION BY location ORDER BY ds"
STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def over(function: str, start: int, end: int = 0) -> str:
    """Row frame from ``start`` rows back to ``end`` rows back."""
    tail = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"{function} OVER ({ORDER} ROWS BETWEEN {start} PRECEDING AND {tail})"


def full_frame(stat: str, rows: int) -> str:
    return f"CASE WHEN {over('count(y)', rows - 1)} = {rows} THEN {over(f'{STATS[stat]}(y)', rows - 1)} END"


def lag_sql(lags, prefix: str) -> str:
    return ", ".join(f"lag(y, {k}) OVER ({ORDER}) AS {prefix}{k}" for k in lags)


def keep(df, *columns):
    return rounded(df.select("location", "ds", *[named(c) for c in columns]))


def added(spark, sf, transform):
    """The new columns a transform adds to the series, with their keys."""
    series = tables.series(spark, sf)
    out = transform(series)
    return keep(out, *[c for c in out.columns if c not in series.columns])


@query("w01_lag_1_7", with_views(f"SELECT location, ds, lag(y, 1) OVER ({ORDER}) AS prev_1, lag(y, 7) OVER ({ORDER}) AS prev_7 FROM series", "series"))
def w01(spark, sf):
    return added(spark, sf, lambda s: windows.lag_columns(s, (1, 7), "prev_"))


@query("w02_y_lags", with_views(f"SELECT location, ds, {lag_sql((1, 7, 14, 30), 'y_lag_')} FROM series", "series"))
def w02(spark, sf):
    return added(spark, sf, lambda s: windows.lag_columns(s, prefix="y_lag_"))


@query("w03_model_lags", with_views(f"SELECT location, ds, {lag_sql((1, 7, 14, 30), 'lag_')} FROM series", "series"))
def w03(spark, sf):
    return added(spark, sf, windows.lag_columns)


@query(
    "w04_moving_average",
    with_views(f"SELECT location, ds, {q6(over('avg(y)', 6), 'ma_7_days')}, {q6(over('avg(y)', 29), 'ma_30_days')} FROM series", "series"),
)
def w04(spark, sf):
    return added(spark, sf, windows.moving_averages)


@query(
    "w05_rolling_full",
    with_views(
        "SELECT location, ds, " + ", ".join(q6(full_frame(s, n), f"y_rolling_{s}_{n}") for n in (7, 14, 30) for s in STATS) + " FROM series", "series"
    ),
)
def w05(spark, sf):
    rolled = added(spark, sf, windows.rolling_columns)
    return rolled.select(*[F.col(c).cast("double").alias(c) if c.startswith("y_") else c for c in rolled.columns])


@query(
    "w06_leak_free_rolling",
    with_views(
        "SELECT location, ds, "
        + ", ".join(q6(over(f"{STATS[s]}(y)", n, 1), f"rolling_{s}_{n}") for n in (7, 14, 30) for s in ("mean", "std"))
        + " FROM series",
        "series",
    ),
)
def w06(spark, sf):
    return added(spark, sf, windows.leak_free_rolling)


def ewm_sql(alpha: float) -> str:
    keep_share = f"(1 - {alpha}::DOUBLE)"
    value = f"list_sum(list_transform(h, lambda x, i: x * pow({keep_share}, len(h) - i)))"
    weight = f"list_sum(list_transform(h, lambda x, i: pow({keep_share}, len(h) - i)))"
    return q6(f"{value} / {weight}", f'"y_ema_{alpha}"')


@query(
    "w07_ewm",
    with_views(
        f"""SELECT location, ds, {', '.join(ewm_sql(a) for a in (0.1, 0.3, 0.5))}
            FROM (SELECT location, ds, list(CAST(y AS DOUBLE)) OVER ({ORDER} ROWS BETWEEN 400 PRECEDING AND CURRENT ROW) AS h FROM series)""",
        "series",
    ),
)
def w07(spark, sf):
    return added(spark, sf, windows.ewm_columns)


@query("w08_trend", with_views(f"SELECT location, ds, y - lag(y, 7) OVER ({ORDER}) AS y_trend_7d, y - lag(y, 30) OVER ({ORDER}) AS y_trend_30d FROM series", "series"))
def w08(spark, sf):
    return added(spark, sf, windows.trend_columns)


@query(
    "w09_volatility",
    with_views(f"SELECT location, ds, {q6(full_frame('std', 7), 'y_volatility_7d')}, {q6(full_frame('std', 30), 'y_volatility_30d')} FROM series", "series"),
)
def w09(spark, sf):
    return added(spark, sf, windows.volatility_columns)


@query(
    "w10_history_rolling",
    with_views(
        f"""SELECT location, ds, {q6(full_frame('mean', 7), 'rolling_mean_7')}, {q6(full_frame('std', 7), 'rolling_std_7')},
                   {q6(full_frame('mean', 30), 'rolling_mean_30')} FROM series""",
        "series",
    ),
)
def w10(spark, sf):
    def both(series):
        out = windows.rolling_columns(series, (7,), ("mean", "std"), "rolling_")
        return windows.rolling_columns(out, (30,), ("mean",), "rolling_")

    return added(spark, sf, both)


@query("w11_row_trend", with_views("SELECT location, ds, r AS trend FROM positions", "positions"))
def w11(spark, sf):
    return added(spark, sf, windows.row_trend)


@query(
    "w12_first_difference",
    with_views(f"SELECT * FROM (SELECT location, ds, y - lag(y) OVER ({ORDER}) AS y_diff FROM series) WHERE y_diff IS NOT NULL", "series"),
)
def w12(spark, sf):
    return added(spark, sf, windows.first_difference)


STATUS_DAYS = "SELECT l_linestatus AS status, CAST(l_shipdate AS DATE) AS ds, count(*) AS total FROM lineitem GROUP BY ALL"


def status_days(spark, sf):
    lines = tables.table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("ds")).agg(F.count("*").alias("total"))


@query(
    "w13_daily_increase",
    f"SELECT status, ds, total, coalesce(total - lag(total) OVER (PARTITION BY status ORDER BY ds), total) AS increase FROM ({STATUS_DAYS})",
)
def w13(spark, sf):
    return windows.daily_increase(status_days(spark, sf), "total", "increase", "status")


@query(
    "w14_forward_average",
    f"""SELECT status, ds, total, {q6("avg(total) OVER (PARTITION BY status ORDER BY ds ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)", 'ahead_7')} FROM ({STATUS_DAYS})""",
)
def w14(spark, sf):
    return rounded(windows.forward_average(status_days(spark, sf), "total", "ahead_7", 7, "status"))


@query(
    "w15_fill_forward_back",
    with_views(
        f"""SELECT location, ds, coalesce(last_value(l IGNORE NULLS) OVER ({ORDER}), first_value(l IGNORE NULLS) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y,
                   {q6(f'last_value(disease_severity IGNORE NULLS) OVER ({ORDER})', 'disease_severity')}
            FROM (SELECT *, lag(y, 30) OVER ({ORDER}) AS l FROM gapped)""",
        "gapped",
    ),
)
def w15(spark, sf):
    gapped = panel.calendar_join(tables.daily(spark, sf))
    late = windows.lag_columns(gapped, (30,)).withColumn("y", F.col("lag_30")).drop("lag_30")
    return keep(windows.fill_forward_back(late, ["y", "disease_severity"]), "y", "disease_severity")


@query("w16_interpolate", with_views("SELECT location, ds, y, is_weekend, month FROM series", "series"))
def w16(spark, sf):
    """Interpolation of the nulls of a calendar-joined panel; the series view fuses both steps."""
    filled = windows.interpolate(panel.calendar_join(tables.daily(spark, sf)))
    return rounded(filled.select("location", "ds", "y", (F.weekday("ds") >= 5).cast("long").alias("is_weekend"), F.month("ds").alias("month")))


@query("w17_holdout_split", with_views("SELECT location, ds, y, r >= n - 30 AS is_test FROM positions", "positions"))
def w17(spark, sf):
    return keep(windows.split_last_rows(tables.series(spark, sf)), "y", "is_test")
