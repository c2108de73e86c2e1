import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.models import importance
from panelcast.operators import panel, relevance
from panelcast.sources import files


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n) + 1e6
    rows = [(i, float(3 * a[i] + rng.normal()), None if i % 9 == 0 else float(a[i]), float(b[i]), 5, int(rng.integers(0, 3))) for i in range(n)]
    return spark.createDataFrame([(r[0], *r[1:]) for r in rows], "i long, y double, `a.x` double, b double, flat int, few int")


NAMES = ["a.x", "b", "flat", "few"]


def test_moments_of_batches_give_the_correlation(spark):
    df = frame(spark).repartition(5)
    got = {r["feature"]: r["correlation"] for r in relevance.correlations(df, NAMES).collect()}
    data = df.toPandas()
    for name in NAMES:
        want = 0.0 if name == "flat" else abs(data["y"].corr(data[name]))
        assert got[name] == pytest.approx(want, abs=1e-9)
    none = {r["feature"]: r["correlation"] for r in relevance.correlations(df.withColumn("a.x", F.lit(None).cast("double")), NAMES).collect()}
    assert none["a.x"] == 0 and relevance.correlations(df.limit(0), NAMES).count() == 0


def plain_bins(values, bins):
    ordered = np.sort(values)
    return np.searchsorted(ordered, values, side="left") * bins // len(values)


def test_information_over_quantile_bins(spark):
    df = frame(spark).repartition(3)
    data = df.toPandas()
    got = {r["feature"]: r["mutual_information"] for r in relevance.mutual_information(df, NAMES).collect()}
    by = dict(zip(data["i"], plain_bins(data["y"].to_numpy(), 10)))
    for name in NAMES:
        known = data[data[name].notna()]
        pairs = list(zip(plain_bins(known[name].to_numpy(float), 10), (by[i] for i in known["i"])))
        joint, n, want = {}, len(pairs), 0.0
        for p in pairs:
            joint[p] = joint.get(p, 0) + 1
        for (x, y), c in joint.items():
            nx, ny = sum(v for k, v in joint.items() if k[0] == x), sum(v for k, v in joint.items() if k[1] == y)
            want += c / n * np.log(c * n / (nx * ny))
        assert got[name] == pytest.approx(want, abs=1e-9)
    assert got["a.x"] > got["b"] and got["flat"] == 0


def test_edges_split_a_long_column_into_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).cast("double").alias("v"), F.lit(1.0).alias("w")).repartition(8)
    rows = {(r["feature"], r["bin"]): r["edge"] for r in relevance.quantile_edges(df, ["v", "w"], 10).collect()}
    assert rows == {**{("v", i): 500.0 * i for i in range(10)}, ("w", 0): 1.0}


def plan(df):
    with redirect_stdout(io.StringIO()) as text:
        df.explain("simple")
    return text.getvalue()


def wide_rows(spark, days):
    rows = [(k, "2020-01-01", d, (d * 3 + i) % 7) for i, k in enumerate(("x", 'quo"ted, name', "z")) for d in range(days) if (d + i) % 4]
    return spark.createDataFrame(rows, "id string, first string, d int, n long").select("id", F.date_add(F.to_date("first"), F.col("d")).alias("ds"), "n")


def test_wide_tables_round_trip_and_their_plan_does_not_grow(spark, tmp_path):
    sizes = []
    for days in (50, 900):
        long = wide_rows(spark, days)
        saved = str(tmp_path / f"long{days}")
        long.write.parquet(saved)
        long = spark.read.parquet(saved)
        calendar = panel.day_positions(long)
        wide = panel.wide_by_day(long, ["id"], "n", calendar)
        assert {len(r["values"]) for r in wide.collect()} == {days}
        path = str(tmp_path / f"wide{days}")
        files.write_wide(wide, calendar, path, ["id"])
        back, named = files.read_wide(spark, [path + "-missing", path], ["id"])
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
        sums = panel.column_sums(back, named, "total")
        want = {r["ds"]: r["t"] for r in long.groupBy("ds").agg(F.sum("n").alias("t")).collect()}
        assert {r["ds"]: r["total"] for r in sums.collect()} == want
        sizes.append((len(plan(wide).splitlines()), len(plan(sums).splitlines())))
    # the size of the inputs may change the kind of a join, not the size of the plan
    assert all(big <= small + 5 for small, big in zip(*sizes))


def test_metrics_document_of_maps(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ('b "x"', float("nan"), 2.0)], "location string, mae double, mape double")
    for documents in (1, 3):
        path = str(tmp_path / f"m{documents}")
        files.write_metrics(df, path, ["mae", "mape"], documents=documents)
        rows = {(r["location"], r["metric"]): r["value"] for r in files.read_metrics(spark, path).collect()}
        assert rows["a", "mae"] == 1.5 and rows["a", "mape"] is None and rows['b "x"', "mape"] == 2 and np.isnan(rows['b "x"', "mae"])
    (tmp_path / "hand.json").write_text('{\n  "a": {"mae": 1,\n "mape": 2.5},\n "b": {}\n}')
    assert sorted(map(tuple, files.read_metrics(spark, str(tmp_path / "hand.json")).collect())) == [("a", "mae", 1.0), ("a", "mape", 2.5)]


def test_a_lost_writer_leaves_the_pair_before(spark, tmp_path):
    folder = str(tmp_path / "pair")
    numbers = lambda n: spark.range(n)
    files.write_pair(numbers(3), numbers(1), folder)

    class Lost:
        schema = numbers(1).schema

        @property
        def write(self):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        files.write_pair(numbers(9), Lost(), folder)
    assert [t.count() for t in files.read_pair(spark, folder)] == [3, 1]
    files.write_pair(numbers(5), numbers(2), folder)
    assert [t.count() for t in files.read_pair(spark, folder)] == [5, 2]


def test_a_planted_feature_is_the_most_important(spark):
    rng, rows = np.random.default_rng(3), []
    for k, strong in (("p", 0), ("q", 2)):
        x = rng.normal(size=(200, 3))
        rows += [(k, i, float(10 * x[i, strong] + rng.normal()), *[None if i == 5 else float(v) for v in x[i]], 7.0) for i in range(200)]
    rows += [("short", 1, 1.0, 1.0, 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "location string, i int, y double, a double, `b.1` double, c double, flat double").withColumn("ds", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))
    scores = importance.permutation_importances(df, ["a", "b.1", "c", "flat"]).collect()
    best = {k: max((r for r in scores if r["location"] == k), key=lambda r: r["importance"])["feature"] for k in ("p", "q")}
    assert best == {"p": "a", "q": "c"} and len(scores) == 8
    assert all(r["importance"] == 0 for r in scores if r["feature"] == "flat")
    assert sorted(scores) == sorted(importance.permutation_importances(df.repartition(4), ["a", "b.1", "c", "flat"]).collect())
