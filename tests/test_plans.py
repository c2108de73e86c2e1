from pyspark.sql import functions as F

from panelcast.plans import panel_job
from panelcast.sources import tables
from panelcast.sources.tables import PRIORITY_SEVERITY

FOLDER = "/root/testdata/sf0.001"


def test_whole_chain(spark, tmp_path):
    raw = tables.dirty_admissions(spark, FOLDER)
    paths = panel_job.run(raw, str(tmp_path), PRIORITY_SEVERITY, periods=7)
    series = spark.read.parquet(paths["series"])
    assert series.select("location").distinct().count() == 5
    spans = series.groupBy("location").agg(F.count("*").alias("n"), (F.datediff(F.max("ds"), F.min("ds")) + 1).alias("d")).collect()
    assert all(r.n == r.d for r in spans)
    forecasts = spark.read.parquet(paths["forecasts"])
    assert {r["model"]: r["count"] for r in forecasts.groupBy("model").count().collect()} == {
        "historical_average": 35, "ar1_diff0": 35, "additive": 35, "ensemble": 35,
    }
    assert forecasts.filter(F.isnan("yhat") | F.col("yhat").isNull()).count() == 0
    assert spark.read.parquet(paths["features"]).count() == series.count()
    assert spark.read.parquet(paths["metrics"]).count() == 15
    assert spark.read.json(paths["backtest"]).filter("cv_mape > 0 and rolling_mape > 0").count() == 5
    assert spark.read.json(paths["quality"]).first().locations == 5
