"""Polynomial trend regression with an ordered split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Degree, days left out at the start, share of the last days used
# for testing, and days predicted beyond the end.
DEGREE, SKIP_DAYS, TEST_SHARE, AHEAD = 3, 922, 0.07, 10


def elimination(size: int) -> list[dict[str, str]]:
    """SQL expressions that solve symmetric normal equations, stage by stage.

    Inputs are the power sums p0 … and the right sides q0 …; the last stage gives the
    coefficients c0 …. The text is plain arithmetic, the same in every SQL dialect.
    """
    def cell(i: int, j: int) -> str:
        return f"a0_{i}_{j}"

    first = {cell(i, j): f"p{i + j}" for i in range(size) for j in range(size)} | {cell(i, size): f"q{i}" for i in range(size)}
    stages = [first]
    for k in range(size - 1):
        kept = {f"a{k + 1}_{i}_{j}": f"a{k}_{i}_{j}" for i in range(k + 1) for j in range(i, size + 1)}
        lower = {f"a{k + 1}_{i}_{j}": f"a{k}_{i}_{j} - a{k}_{i}_{k} / a{k}_{k}_{k} * a{k}_{k}_{j}" for i in range(k + 1, size) for j in range(k + 1, size + 1)}
        stages.append(kept | lower)
    for i in range(size - 1, -1, -1):
        known = "".join(f" - a{size - 1}_{i}_{j} * c{j}" for j in range(i + 1, size))
        stages.append({f"c{i}": f"(a{size - 1}_{i}_{size}{known}) / a{size - 1}_{i}_{i}"})
    return stages


def power(name: str, k: int) -> str:
    return " * ".join([name] * k) if k else "1.0"


def polynomial_trend(
    totals: DataFrame, ds: str = "ds", y: str = "y", degree: int = DEGREE, skip: int = SKIP_DAYS, test_share: float = TEST_SHARE, ahead: int = AHEAD
) -> DataFrame:
    """Least-squares fit of y on powers of the day number; actuals and predictions by day and part.

    ``totals`` holds one row per day, so the calendar bounds the one window that carries
    the span and the power sums of the training days to every row; the data is read once.
    The day is scaled to -1 … 1 over the span.
    """
    whole = Window.partitionBy(F.lit(1))
    spanned = totals.select(F.col(ds).alias("ds"), F.col(y).cast("double").alias("label"), F.min(ds).over(whole).alias("_a"), F.max(ds).over(whole).alias("_b"))
    # the last day brings the days beyond the end along
    steps = F.when(F.col("ds") == F.col("_b"), F.sequence(F.lit(0), F.lit(ahead))).otherwise(F.array(F.lit(0)))
    days = spanned.withColumn("_k", F.explode(steps)).withColumn("ds", F.date_add("ds", F.col("_k")))
    days = days.withColumn("label", F.when(F.col("_k") == 0, F.col("label")))
    last = F.datediff("_b", "_a")
    first_test = last + 1 - F.ceil((last + 1 - skip) * test_share)
    day = F.datediff("ds", "_a").cast("double")
    part = F.when(F.col("_k") > 0, "future").when(day < skip, "skipped").when(day < first_test, "train").otherwise("test")
    scaled = days.select("ds", "label", day.alias("day"), part.alias("part"), ((2 * day - last) / F.greatest(last, F.lit(1))).alias("t"))
    trained: Column = F.col("part") == "train"
    sums = {f"p{k}": F.sum(F.when(trained, F.expr(power("t", k)).cast("double"))).over(whole) for k in range(2 * degree + 1)}
    sums |= {f"q{k}": F.sum(F.when(trained, F.expr(f"label * {power('t', k)}"))).over(whole) for k in range(degree + 1)}
    solved = scaled.withColumns(sums)
    for stage in elimination(degree + 1):
        solved = solved.withColumns({name: F.expr(text) for name, text in stage.items()})
    yhat = F.expr(" + ".join(f"c{k} * {power('t', k)}" for k in range(degree + 1)))
    return solved.select(F.col("ds").alias(ds), "day", F.col("label").alias("actual"), yhat.alias("yhat"), "part")
