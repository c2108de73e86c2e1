"""The whole chain as one driver script: admissions to series, features, forecasts, reports.

Every stage writes its table and the next one reads it back, so a lost
executor costs at most the stage it was working on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..models import additive, autoregressive, baseline, ensemble, folds
from ..operators import clean, features, panel
from ..operators.holidays import HOLIDAYS
from ..operators.keys import lookup
from ..reports import summaries
from ..sources import files

# Tables written below the output folder.
TABLES = ("admissions", "series", "features", "forecasts", "holdout", "metrics", "backtest", "quality")


def prepare(admissions: DataFrame, severity: Mapping[str, int] = clean.SEVERITY) -> DataFrame:
    """Cleaned admissions with the severity of their condition."""
    cleaned = clean.clean(admissions)
    return cleaned.withColumn("disease_severity", lookup(F.col("disease_type"), severity, 1))


def forecast_all(series: DataFrame, periods: int = baseline.HORIZON) -> DataFrame:
    """Forecasts of every model in one long table, the ensemble among them."""
    columns = ["location", "ds", "yhat", "yhat_lower", "yhat_upper", "model"]
    nothing = F.lit(None).cast("double")
    plain = [baseline.mean_forecast(series, periods), autoregressive.autoregressive_forecast(series, periods)]
    points = [p.withColumns({"yhat_lower": nothing, "yhat_upper": nothing}).select(*columns) for p in plain]
    members = additive.forecast(series, periods, additive.ENSEMBLE)
    combined = ensemble.ensemble(members).withColumn("model", F.lit("ensemble"))
    single = additive.forecast(series, periods)
    tables = [*points, single.select(*columns), combined.select(*columns)]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def holdout_all(series: DataFrame, test_rows: int = baseline.LAST_ROWS) -> DataFrame:
    """Hold-out predictions of every single model."""
    scored = {
        "historical_average": baseline.holdout_forecast(series, test_rows),
        "ar1_diff0": autoregressive.holdout_forecast(series, test_rows),
        "additive": additive.holdout(series, test_rows),
    }
    named = [df.select("location", "ds", "actual", "yhat", F.lit(name).alias("model")) for name, df in scored.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def backtest(series: DataFrame) -> DataFrame:
    """Cross-validated and rolling errors of the additive model, and their mean."""
    scored = additive.cross_validate(series, {"backtest": additive.BACKTEST}, **folds.CV)
    per_step = folds.horizon_metrics(scored, "yhat", F.col("yhat_lower"), F.col("yhat_upper"))
    rolled = folds.backtest_metrics(additive.rolling_backtest(series, **folds.ROLLING), "yhat")
    return summaries.overall_performance(folds.mean_over_horizons(per_step), rolled)


def run(
    admissions: DataFrame,
    folder: str,
    severity: Mapping[str, int] = clean.SEVERITY,
    holidays: Mapping[str, Sequence[str]] | DataFrame = HOLIDAYS,
    periods: int = baseline.HORIZON,
) -> dict[str, str]:
    """Run all stages; returns the path of each table."""
    spark = admissions.sparkSession
    paths = {name: f"{folder}/{name}" for name in TABLES}

    def saved(name: str, df: DataFrame, *partitions: str) -> DataFrame:
        if partitions:
            files.write_by(df, paths[name], *partitions)
        else:
            files.replace_table(df, paths[name])
        return spark.read.parquet(paths[name])

    prepared = saved("admissions", prepare(admissions, severity))
    files.write_json(summaries.data_quality(prepared), paths["quality"])
    series = saved("series", panel.fill_date_gaps(panel.daily_totals(prepared)))
    saved("features", features.all_features(series, holidays))
    saved("forecasts", forecast_all(series, periods), "model")
    holdout = saved("holdout", holdout_all(series), "model")
    saved("metrics", folds.error_table(holdout, ["model", "location"]))
    files.write_json(backtest(series), paths["backtest"])
    return paths
