"""SQL text of the shared views, combined into WITH clauses on demand."""

from __future__ import annotations



def ar_steps(phi: str, constant: str, last: str, step: str) -> str:
    """Value of the recursive forecast after so many steps; an undefined slope repeats the last value."""
    grown = f"CASE WHEN abs(1 - {phi}) < 1e-12 THEN {constant} * {step} ELSE {constant} * (1 - pow({phi}, {step})) / (1 - {phi}) END"
    return f"CASE WHEN {phi} IS NULL OR isnan({phi}) THEN CAST({last} AS DOUBLE) ELSE {grown} + pow({phi}, {step}) * {last} END"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "episodes": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS date, r_name AS location, n_name AS nation,
                  o_orderpriority AS disease_type, (c_acctbal + 1000) / 100 AS age, o_orderkey AS order_id
           FROM orders JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "grouped": (
        ("episodes",),
        """SELECT *, CASE WHEN age >= 0 AND age < 18 THEN '0-18' WHEN age >= 18 AND age < 30 THEN '19-30'
                         WHEN age >= 30 AND age < 50 THEN '31-50' WHEN age >= 50 AND age < 65 THEN '51-65'
                         WHEN age >= 65 AND age < 120 THEN '65+' END AS age_group FROM episodes""",
    ),
    "admissions": (
        ("grouped",),
        """SELECT date, location, disease_type, age_group, count(*) AS admission_count,
                  CASE disease_type WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS disease_severity
           FROM grouped GROUP BY ALL""",
    ),
    "daily": (
        ("admissions",),
        """SELECT location, date AS ds, CAST(sum(admission_count) AS BIGINT) AS y, avg(disease_severity) AS disease_severity
           FROM admissions GROUP BY ALL""",
    ),
    "calendar": (
        ("daily",),
        """SELECT location, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
           FROM daily GROUP BY location""",
    ),
    "gapped": (
        ("calendar",),
        "SELECT c.location, c.ds, d.y, d.disease_severity FROM calendar c LEFT JOIN daily d ON c.location = d.location AND c.ds = d.ds",
    ),
    "series": (
        ("gapped",),
        """SELECT location, ds, CAST(round_even(CASE WHEN y IS NOT NULL THEN CAST(y AS DOUBLE)
                    ELSE py + CAST((ny - py) * date_diff('day', pd, ds) AS DOUBLE) / date_diff('day', pd, nd) END, 0) AS BIGINT) AS y,
                  CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend, month(ds) AS month,
                  last_value(disease_severity IGNORE NULLS) OVER (PARTITION BY location ORDER BY ds) AS disease_severity
           FROM (SELECT *, last_value(y IGNORE NULLS) OVER back AS py, first_value(y IGNORE NULLS) OVER ahead AS ny,
                        last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER back AS pd,
                        first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER ahead AS nd
                 FROM gapped
                 WINDOW back AS (PARTITION BY location ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        ahead AS (PARTITION BY location ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) g""",
    ),
    "cities": (
        ("series",),
        """SELECT CASE location WHEN 'AFRICA' THEN 'Can Tho' WHEN 'AMERICA' THEN 'Ha Noi' WHEN 'ASIA' THEN 'Ho Chi Minh City'
                       WHEN 'EUROPE' THEN 'Da Nang' ELSE location END AS location,
                  ds + 9496 AS ds, y, CASE WHEN isodow(ds + 9496) >= 6 THEN 1 ELSE 0 END AS is_weekend,
                  month(ds + 9496) AS month, disease_severity FROM series""",
    ),
    "holidays": (
        (),
        """SELECT holiday, CAST(day AS DATE) AS h FROM (VALUES
             ('tet', '2023-01-22'), ('tet', '2023-01-23'), ('tet', '2023-01-24'), ('tet', '2023-01-25'), ('tet', '2023-01-26'),
             ('tet', '2024-02-10'), ('tet', '2024-02-11'), ('tet', '2024-02-12'), ('tet', '2024-02-13'), ('tet', '2024-02-14'),
             ('kings', '2023-04-29'), ('kings', '2024-04-18'), ('liberation', '2023-04-30'), ('liberation', '2024-04-30'),
             ('labor', '2023-05-01'), ('labor', '2024-05-01'), ('national', '2023-09-02'), ('national', '2024-09-02'),
             ('autumn', '2023-09-29'), ('autumn', '2024-09-17')) t(holiday, day)""",
    ),
    "flags": (
        (),
        """SELECT user_id, CAST(ts AS DATE) AS day, """
        + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS {k}" for k in ("click", "error", "purchase", "signup", "view"))
        + " FROM events GROUP BY ALL",
    ),
    "returns": (
        (),
        """SELECT CAST(l_shipdate AS DATE) AS ds, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS total
           FROM lineitem GROUP BY ALL""",
    ),
    "beds": (
        (),
        """SELECT r_name AS location, count(*) * 10 AS total_beds, count(*) AS icu_beds
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    ),
    "dirty": (
        ("admissions",),
        """SELECT date, location, disease_type, age_group, admission_count FROM admissions
           UNION ALL SELECT date, location, disease_type, age_group, admission_count FROM admissions WHERE disease_type = '1-URGENT'
           UNION ALL SELECT date, location, NULL, NULL, -admission_count FROM admissions WHERE disease_type = '5-LOW'
           UNION ALL SELECT date, location, NULL, age_group, admission_count * 1000 FROM admissions WHERE disease_type = '2-HIGH' AND day(date) = 1
           UNION ALL SELECT date + 36525, location, disease_type, NULL, admission_count FROM admissions WHERE disease_type = '3-MEDIUM'
           UNION ALL SELECT date, location, disease_type, age_group, NULL FROM admissions WHERE disease_type = '4-NOT SPECIFIED' AND month(date) = 1""",
    ),
    "deduplicated": (("dirty",), "SELECT DISTINCT * FROM dirty"),
    "not_negative": (("deduplicated",), "SELECT * FROM deduplicated WHERE admission_count >= 0"),
    "inliers": (
        ("not_negative",),
        """SELECT n.* FROM not_negative n, (SELECT avg(admission_count) AS m, stddev_samp(admission_count) AS s FROM not_negative)
           WHERE abs(admission_count - m) <= 5 * s""",
    ),
    "cleaned": (
        ("inliers",),
        """SELECT date, location, coalesce(disease_type, 'Unknown') AS disease_type, coalesce(age_group, 'Unknown') AS age_group, admission_count
           FROM inliers WHERE date <= current_date""",
    ),
    "capacity": (
        ("admissions",),
        """SELECT l.location, d.date, 300 AS total_beds, 30 AS icu_beds,
                  greatest(0, CAST(trunc(300 + 300 * CAST(0.05 AS DOUBLE) * ((date_diff('day', DATE '1970-01-01', d.date) % 201) / CAST(100 AS DOUBLE) - 1)) AS BIGINT)) AS available_beds
           FROM (SELECT DISTINCT location FROM admissions) l CROSS JOIN (SELECT DISTINCT date FROM admissions) d""",
    ),
    "positions": (
        ("series",),
        """SELECT *, row_number() OVER (PARTITION BY location ORDER BY ds) - 1 AS r, count(*) OVER (PARTITION BY location) AS n FROM series""",
    ),
    "mean_test": (
        ("positions",),
        """SELECT p.location, p.ds, p.y AS actual, t.level * CASE WHEN isodow(p.ds) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS yhat
           FROM positions p JOIN (SELECT location, avg(y) AS level FROM positions WHERE r < n - 30 GROUP BY location) t
           ON p.location = t.location WHERE p.r >= p.n - 30 AND p.n >= 60""",
    ),
    "ar_fit": (
        ("positions",),
        """SELECT location, count(*) AS n, avg(y) AS level, coalesce(regr_slope(y, y1), 1.0) AS phi,
                  coalesce(regr_intercept(y, y1), 0.0) AS constant,
                  coalesce(sum((y - y1) * (y1 - y2)) / nullif(sum((y1 - y2) * (y1 - y2)), 0), 0.0) AS phi_diff,
                  max(ds) AS last_ds, max_by(y, ds) AS last_y, max_by(y1, ds) AS last_y1
           FROM (SELECT location, ds, CAST(y AS DOUBLE) AS y, lag(CAST(y AS DOUBLE)) OVER w AS y1, lag(CAST(y AS DOUBLE), 2) OVER w AS y2
                 FROM series WINDOW w AS (PARTITION BY location ORDER BY ds)) GROUP BY location""",
    ),
    "ar_test": (
        ("positions",),
        f"""SELECT p.location, p.ds, p.y AS actual, {ar_steps('t.phi', 't.c', 't.last_y', '(p.r - (p.n - 31))')} AS yhat
           FROM positions p JOIN (
             SELECT location, regr_slope(y, y1) AS phi, regr_intercept(y, y1) AS c, max_by(y, ds) AS last_y
             FROM (SELECT *, lag(y) OVER (PARTITION BY location ORDER BY ds) AS y1 FROM positions WHERE r < n - 30) GROUP BY location) t
           ON p.location = t.location WHERE p.r >= p.n - 30 AND p.n >= 60""",
    ),
}

ERRORS = """avg(abs(actual - {p})) AS mae, avg((actual - {p}) * (actual - {p})) AS mse, sqrt(avg((actual - {p}) * (actual - {p}))) AS rmse,
  coalesce(avg(abs((actual - {p}) / CAST(actual AS DOUBLE))) FILTER (WHERE actual > 0) * 100, 0) AS mape0,
  avg(CASE WHEN abs(actual) + abs({p}) = 0 THEN 0 ELSE abs(actual - {p}) / ((abs(actual) + abs({p})) / 2) END) * 100 AS smape,
  avg(actual) AS mean_actual, avg({p}) AS mean_predicted, count(*) FILTER (WHERE actual > 0) AS non_zero_samples, count(*) AS test_days"""

VIEWS["mean_scores"] = (
    ("mean_test",),
    f"""SELECT *, least(mape0, 999) AS mape, greatest(0, least(100, 100 - CASE WHEN mape0 < 200 THEN mape0 ELSE smape END)) AS accuracy
        FROM (SELECT location, {ERRORS.format(p='yhat')} FROM mean_test GROUP BY location)""",
)
VIEWS["ar_scores"] = (
    ("ar_test",),
    f"""SELECT *, least(mape0, 999) AS mape, greatest(0, least(100, 100 - CASE WHEN mape0 < 200 THEN mape0 ELSE smape END)) AS accuracy
        FROM (SELECT location, {ERRORS.format(p='yhat')} FROM ar_test GROUP BY location)""",
)
VIEWS["scores"] = (
    ("mean_scores", "ar_scores"),
    """SELECT 'historical_average' AS model, location, mape, accuracy, mae FROM mean_scores
       UNION ALL SELECT 'ar1_diff0', location, mape, accuracy, mae FROM ar_scores""",
)
VIEWS["mean_forecast"] = (
    ("series",),
    """SELECT location, last_ds + step AS ds, step, level * CASE WHEN isodow(last_ds + step) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS yhat,
              'historical_average' AS model
       FROM (SELECT location, avg(y) AS level, max(ds) AS last_ds FROM series GROUP BY location), (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))""",
)
VIEWS["ar_forecast"] = (
    ("ar_fit",),
    f"""SELECT location, last_ds + step AS ds, step, {ar_steps('phi', 'constant', 'last_y', 'step')} AS yhat, 'ar1_diff0' AS model
       FROM ar_fit, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))""",
)
VIEWS["drift_forecast"] = (
    ("ar_fit",),
    """SELECT location, last_ds + step AS ds, step, last_y AS yhat, 'ar0_diff1' AS model
       FROM ar_fit, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 15))""",
)
VIEWS["forecasts"] = (
    ("mean_forecast", "ar_forecast", "drift_forecast"),
    "SELECT * FROM mean_forecast UNION ALL SELECT * FROM ar_forecast UNION ALL SELECT * FROM drift_forecast",
)
# rolling-window backtest: fold, its training state and the predictions of its test rows
VIEWS["rolling"] = (
    ("positions",),
    f"""SELECT t.location, t.cutoff, p.ds, p.r - t.s - 179 AS step, p.y AS actual,
              t.level * CASE WHEN isodow(p.ds) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS yhat_mean,
              {ar_steps('t.phi', 't.c', 't.last_y', '(p.r - t.s - 179)')} AS yhat_ar
       FROM (SELECT f.location, f.s, max(x.ds) AS cutoff, avg(x.y) AS level, max_by(x.y, x.ds) AS last_y,
                    regr_slope(x.y, CASE WHEN x.r > f.s THEN x.y1 END) AS phi, regr_intercept(x.y, CASE WHEN x.r > f.s THEN x.y1 END) AS c
             FROM (SELECT location, unnest(range(0, max(n) - 194, 30)) AS s FROM positions WHERE n >= 210 GROUP BY location) f
             JOIN (SELECT *, lag(y) OVER (PARTITION BY location ORDER BY ds) AS y1 FROM positions) x
               ON x.location = f.location AND x.r >= f.s AND x.r < f.s + 180 GROUP BY f.location, f.s) t
       JOIN positions p ON p.location = t.location AND p.r >= t.s + 180 AND p.r < t.s + 194""",
)
VIEWS["origin"] = (
    ("positions",),
    f"""SELECT t.location, t.cutoff, p.ds, date_diff('day', t.cutoff, p.ds) AS step, p.y AS actual,
              t.level * CASE WHEN isodow(p.ds) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS yhat_mean,
              {ar_steps('t.phi', 't.c', 't.last_y', "date_diff('day', t.cutoff, p.ds)")} AS yhat_ar
       FROM (SELECT f.location, f.cutoff, avg(x.y) AS level, max_by(x.y, x.ds) AS last_y, regr_slope(x.y, x.y1) AS phi, regr_intercept(x.y, x.y1) AS c
             FROM (SELECT location, max(ds) - 14 - unnest(range(0, date_diff('day', min(ds), max(ds)) - 194 + 1, 30))::INTEGER AS cutoff FROM series GROUP BY location) f
             JOIN (SELECT *, lag(y) OVER (PARTITION BY location ORDER BY ds) AS y1 FROM positions) x
               ON x.location = f.location AND x.ds <= f.cutoff GROUP BY f.location, f.cutoff) t
       JOIN positions p ON p.location = t.location AND p.ds > t.cutoff AND p.ds <= t.cutoff + 14""",
)
BACKTEST = """avg(abs(actual - {p})) AS mae, avg((actual - {p}) * (actual - {p})) AS mse, sqrt(avg((actual - {p}) * (actual - {p}))) AS rmse,
  avg(abs(actual - {p}) / greatest(abs(actual), 2.220446049250313e-16::DOUBLE)) * 100 AS mape,
  avg(CAST(sign(da) = sign(round(dp, 9)) AS DOUBLE)) * 100 AS directional_accuracy, count(*) AS total_predictions"""


def backtest_sql(source: str, predicted: str) -> str:
    return f"""SELECT location, {BACKTEST.format(p=predicted)} FROM (
        SELECT *, actual - lag(actual) OVER w AS da, {predicted} - lag({predicted}) OVER w AS dp FROM {source}
        WINDOW w AS (PARTITION BY location, cutoff ORDER BY ds)) GROUP BY location"""


VIEWS["rolling_scores"] = (("rolling",), backtest_sql("rolling", "yhat_ar"))
VIEWS["cv_steps"] = (
    ("origin",),
    """SELECT location, step, avg(abs(actual - yhat_ar)) AS mae, sqrt(avg((actual - yhat_ar) * (actual - yhat_ar))) AS rmse,
              avg(ape) * 100 AS mape, quantile_cont(ape, 0.5) * 100 AS mdape, count(*) AS folds,
              avg(CAST(actual BETWEEN yhat_ar * 0.8::DOUBLE AND yhat_ar * 1.2::DOUBLE AS DOUBLE)) AS coverage
       FROM (SELECT *, CASE WHEN actual > 0 THEN abs((actual - yhat_ar) / actual) END AS ape FROM origin) GROUP BY location, step""",
)
VIEWS["cv_scores"] = (
    ("cv_steps",),
    """SELECT location, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(mdape) AS mdape, avg(coverage) AS coverage,
              max(folds) AS folds, count(*) AS horizons FROM cv_steps GROUP BY location""",
)
VIEWS["overall"] = (
    ("cv_scores", "rolling_scores"),
    """SELECT c.location, c.mape AS cv_mape, r.mape AS rolling_mape, r.directional_accuracy, r.total_predictions, (c.mape + r.mape) / 2 AS avg_mape
       FROM cv_scores c JOIN rolling_scores r ON c.location = r.location""",
)


def with_views(body: str, *names: str) -> str:
    """The body preceded by the views it needs, in order of dependence."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    return f"WITH {clauses}\n{body}" if ordered else body
