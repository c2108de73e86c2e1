"""Projection, filter and clean queries (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import clean, features, panel, windows
from ..operators.keys import lookup
from ..operators.places import POPULATION_EDGES, POPULATION_LABELS
from ..sources import tables
from .registry import q6, query, rounded
from .views import with_views

KIND_LABELS = {"ERROR": "Fault", "PURCHASE": "Sale", "VIEW": "Browse", "PAGE": "Landing"}


@query("p01_drop_duplicates", with_views("SELECT * FROM deduplicated", "deduplicated"))
def p01(spark, sf):
    return clean.drop_duplicate_rows(tables.dirty_admissions(spark, sf))


@query("p02_non_negative", with_views("SELECT * FROM dirty WHERE admission_count >= 0", "dirty"))
def p02(spark, sf):
    return clean.keep_non_negative(tables.dirty_admissions(spark, sf))


@query("p03_outlier_filter", with_views("SELECT * FROM inliers", "inliers"))
def p03(spark, sf):
    kept = clean.keep_non_negative(clean.drop_duplicate_rows(tables.dirty_admissions(spark, sf)))
    return clean.outlier_filter(kept)


@query(
    "p04_fill_unknown",
    with_views(
        "SELECT date, location, coalesce(disease_type, 'Unknown') AS disease_type, coalesce(age_group, 'Unknown') AS age_group, admission_count FROM dirty",
        "dirty",
    ),
)
def p04(spark, sf):
    return clean.fill_unknown(tables.dirty_admissions(spark, sf))


@query("p05_reject_future", with_views("SELECT * FROM dirty WHERE date <= current_date", "dirty"))
def p05(spark, sf):
    return clean.reject_future(tables.dirty_admissions(spark, sf))


@query(
    "p06_removal_audit",
    with_views(
        f"""SELECT a AS initial_rows, b AS final_rows, a - b AS removed_rows, {q6('b / a', 'kept_share')}, b / a < 0.5 AS half_removed
            FROM (SELECT count(*) AS a FROM dirty), (SELECT count(*) AS b FROM cleaned)""",
        "cleaned",
    ),
)
def p06(spark, sf):
    raw = tables.dirty_admissions(spark, sf)
    return rounded(clean.removal_audit(raw, clean.clean(raw)))


@query(
    "p07_date_discovery",
    """SELECT o_orderkey, CAST(DATE '2017-04-01' + CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS DATE) AS parsed_date,
              CAST(o_orderdate AS DATE) AS found_date FROM orders""",
)
def p07(spark, sf):
    """The stand-in index without a date column, and the date column found by its name."""
    orders = tables.table(spark, sf, "orders")
    indexed = clean.parse_record_dates(orders.select("o_orderkey"), order="o_orderkey")
    found = clean.parse_record_dates(orders.select("o_orderkey", "o_orderdate")).select("o_orderkey", F.col("parsed_date").alias("found_date"))
    return indexed.join(found, "o_orderkey")


@query(
    "p08_lenient_date",
    """SELECT o_orderkey, CAST(try_strptime(month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate), '%d/%m/%Y') AS DATE) AS parsed_date FROM orders""",
)
def p08(spark, sf):
    orders = tables.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("date"))
    return clean.parse_record_dates(orders).select("o_orderkey", "parsed_date")


@query(
    "p09_lenient_number",
    f"""SELECT c_custkey, {q6("coalesce(TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), 35)", 'age_numeric')} FROM customer""",
)
def p09(spark, sf):
    customer = tables.table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(F.col("c_acctbal").cast("string"))
    return rounded(clean.parse_age(customer.select("c_custkey", raw.alias("AGE"))).select("c_custkey", "age_numeric"))


@query("p10_bin_half_open", with_views("SELECT order_id, age_group FROM grouped", "grouped"))
def p10(spark, sf):
    return tables.grouped_episodes(spark, sf).select("order_id", "age_group")


@query(
    "p11_bin_right_closed",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal <= 1500 THEN 'small' WHEN c_acctbal > 1500 AND c_acctbal <= 3000 THEN 'medium'
              WHEN c_acctbal > 3000 AND c_acctbal <= 10000 THEN 'large' END AS category FROM customer""",
)
def p11(spark, sf):
    bins = clean.bin_right_closed(F.col("c_acctbal"), POPULATION_EDGES, POPULATION_LABELS)
    return tables.table(spark, sf, "customer").select("c_custkey", bins.alias("category"))


@query(
    "p12_classify_flags",
    with_views(
        """SELECT user_id, day, CASE WHEN error = 1 THEN 'Fault' WHEN purchase = 1 THEN 'Sale' WHEN view = 1 THEN 'Browse'
                  WHEN signup = 1 THEN 'Landing' ELSE 'Other' END AS condition FROM flags""",
        "flags",
    ),
)
def p12(spark, sf):
    flags = tables.event_flags(spark, sf).withColumn("visit_type", F.when(F.col("signup") == 1, "signup page"))
    return flags.select("user_id", "day", clean.classify_flags(flags, KIND_LABELS, "Other").alias("condition"))


@query(
    "p13_assign_groups",
    """SELECT o_orderkey, CASE WHEN b < 40 THEN 'Ludhiana Central' WHEN b < 60 THEN 'Ludhiana South' WHEN b < 75 THEN 'Ludhiana North'
              WHEN b < 90 THEN 'Punjab Rural' ELSE 'Punjab Urban' END AS weighted_place,
              CASE WHEN o_orderstatus = 'F' THEN list_extract(['Punjab Rural', 'Ludhiana North'], CAST(b % 2 + 1 AS INTEGER))
                   WHEN o_orderstatus = 'O' THEN list_extract(['Ludhiana Central', 'Ludhiana South', 'Punjab Urban'], CAST(b % 3 + 1 AS INTEGER))
                   ELSE list_extract(['Ludhiana Central', 'Ludhiana South', 'Ludhiana North', 'Punjab Rural', 'Punjab Urban'], CAST(b % 5 + 1 AS INTEGER))
              END AS split_place
       FROM (SELECT *, o_orderkey % 100 AS b FROM orders)""",
)
def p13(spark, sf):
    bucket = F.col("o_orderkey") % 100
    rural = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no")
    return tables.table(spark, sf, "orders").select(
        "o_orderkey", clean.assign_weighted(bucket).alias("weighted_place"), clean.assign_rural_urban(rural, bucket).alias("split_place")
    )


@query(
    "p14_drop_incomplete",
    with_views("SELECT * FROM dirty WHERE date IS NOT NULL AND age_group IS NOT NULL AND admission_count IS NOT NULL", "dirty"),
)
def p14(spark, sf):
    return clean.drop_incomplete(tables.dirty_admissions(spark, sf), ["date", "age_group", "admission_count"])


@query("p16_select_series", with_views(f"SELECT location, ds, y, is_weekend, month, {q6('disease_severity')} FROM series WHERE location = 'ASIA' ORDER BY ds", "series"))
def p16(spark, sf):
    return rounded(tables.series(spark, sf).filter(F.col("location") == "ASIA").orderBy("ds"))


@query(
    "p17_feature_matrix",
    with_views(
        f"""SELECT location, ds, y, is_weekend, month, {q6('disease_severity')}, coalesce(lag(y, 1) OVER w, 0) AS lag_1, coalesce(lag(y, 7) OVER w, 0) AS lag_7
            FROM series WINDOW w AS (PARTITION BY location ORDER BY ds)""",
        "series",
    ),
)
def p17(spark, sf):
    return rounded(features.feature_matrix(windows.lag_columns(tables.series(spark, sf), (1, 7))))


@query(
    "p18_rename_stamp",
    with_views("SELECT date AS ds, location, disease_type, age_group, admission_count AS y, TRUE AS has_stamp FROM admissions", "admissions"),
)
def p18(spark, sf):
    stamped = tables.admissions(spark, sf).withColumnsRenamed({"date": "ds", "admission_count": "y"}).withColumn("created_at", F.current_timestamp())
    return stamped.select("ds", "location", "disease_type", "age_group", "y", F.col("created_at").isNotNull().alias("has_stamp"))


@query(
    "p19_lookup_default",
    with_views(
        """SELECT date, location, disease_type, age_group,
                  CAST(CASE disease_type WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS BIGINT) AS disease_severity,
                  CAST(CASE location WHEN 'ASIA' THEN 9000000 WHEN 'EUROPE' THEN 8000000 ELSE 500000 END AS BIGINT) AS population
           FROM admissions""",
        "admissions",
    ),
)
def p19(spark, sf):
    population = {"ASIA": 9000000, "EUROPE": 8000000}
    rows = tables.admissions(spark, sf).withColumn("population", lookup(F.col("location"), population, panel.DEFAULT_POPULATION))
    return rounded(rows.select("date", "location", "disease_type", "age_group", "disease_severity", "population"))


@query(
    "p20_rate_per_100k",
    with_views(
        f"""SELECT location, ds, y, {q6("y / CASE location WHEN 'ASIA' THEN 9000000 WHEN 'EUROPE' THEN 8000000 ELSE 500000 END * 100000", 'admissions_per_100k')} FROM daily""",
        "daily",
    ),
)
def p20(spark, sf):
    size = lookup(F.col("location"), {"ASIA": 9000000, "EUROPE": 8000000}, panel.DEFAULT_POPULATION)
    daily = tables.daily(spark, sf)
    return rounded(daily.select("location", "ds", "y", panel.per_100k(F.col("y"), size).alias("admissions_per_100k")))


@query(
    "p21_label_encode",
    """SELECT c_custkey, c_mktsegment, c_name, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_code,
              dense_rank() OVER (ORDER BY c_name) - 1 AS c_name_code FROM customer""",
)
def p21(spark, sf):
    customer = tables.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    coded = features.encode_labels(features.encode_labels(customer, "c_mktsegment"), "c_name")
    return coded


@query(
    "p22_fill_mean",
    with_views(
        f"""SELECT location, ds, {q6('coalesce(l, avg(l) OVER ())', 'lag_7')}, {q6('coalesce(t, avg(t) OVER ())', 'y_trend_30d')}
            FROM (SELECT location, ds, CAST(lag(y, 7) OVER w AS DOUBLE) AS l, CAST(y - lag(y, 30) OVER w AS DOUBLE) AS t
                  FROM series WINDOW w AS (PARTITION BY location ORDER BY ds))""",
        "series",
    ),
)
def p22(spark, sf):
    frame = windows.trend_columns(windows.lag_columns(tables.series(spark, sf), (7,)), (30,))
    return rounded(features.fill_with_mean(frame, ["lag_7", "y_trend_30d"]).select("location", "ds", "lag_7", "y_trend_30d"))


@query(
    "s01_flag_words",
    """SELECT o_orderkey, upper(trim(o_orderpriority)) AS word, contains(upper(o_orderpriority), 'LOW') AS has_low,
              upper(trim(o_orderstatus)) IN ('F', 'O') AS is_listed, upper(trim(substr(o_orderpriority, 1, 1))) IN ('1', 'YES', 'Y', 'TRUE') AS is_set FROM orders""",
)
def s01(spark, sf):
    priority = F.col("o_orderpriority")
    return tables.table(spark, sf, "orders").select(
        "o_orderkey",
        F.upper(F.trim(priority)).alias("word"),
        F.upper(priority).contains("LOW").alias("has_low"),
        F.upper(F.trim("o_orderstatus")).isin("F", "O").alias("is_listed"),
        text.is_set(F.substring(priority, 1, 1)).alias("is_set"),
    )


@query("s02_slug", "SELECT r_name, lower(replace(r_name, ' ', '_')) AS slug FROM region")
def s02(spark, sf):
    return tables.table(spark, sf, "region").select("r_name", text.slug(F.col("r_name")).alias("slug"))


@query(
    "s03_unslug",
    """SELECT n_name, upper(substr(n_name, 1, 1)) || lower(substr(replace(n_name, '_', ' '), 2)) AS title FROM nation""",
)
def s03(spark, sf):
    path = F.concat(F.lit("folder/forecast_"), text.slug(F.col("n_name")), F.lit(".csv"))
    return tables.table(spark, sf, "nation").select("n_name", text.unslug(path, "forecast_", ".csv").alias("title"))


@query("s04_iso_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders")
def s04(spark, sf):
    return tables.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"))


@query(
    "s05_scalar_math",
    f"""SELECT c_custkey, {q6('abs(c_acctbal)', 'absolute')}, CAST(sign(c_acctbal) AS BIGINT) AS direction, {q6('sqrt(abs(c_acctbal))', 'root')},
               c_custkey % 7 AS remainder, {q6('round(c_acctbal, 1)', 'one_decimal')}, {q6('greatest(0, least(100, c_acctbal / 50))', 'clamped')},
               {q6('least(c_acctbal, 999)', 'capped')} FROM customer""",
)
def s05(spark, sf):
    balance = F.col("c_acctbal")
    return rounded(
        tables.table(spark, sf, "customer").select(
            "c_custkey",
            F.abs(balance).alias("absolute"),
            F.signum(balance).cast("long").alias("direction"),
            F.sqrt(F.abs(balance)).alias("root"),
            (F.col("c_custkey") % 7).alias("remainder"),
            F.round(balance, 1).alias("one_decimal"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), balance / 50)).alias("clamped"),
            F.least(balance, F.lit(999.0)).alias("capped"),
        )
    )


@query(
    "s07_to_json",
    with_views(
        """SELECT location, '{"total":' || CAST(sum(y) AS BIGINT) || ',"range":{"start":"' || strftime(min(ds), '%Y-%m-%d') || '","end":"' || strftime(max(ds), '%Y-%m-%d') || '"}}' AS document
           FROM daily GROUP BY location""",
        "daily",
    ),
)
def s07(spark, sf):
    sums = tables.daily(spark, sf).groupBy("location").agg(F.sum("y").alias("total"), F.min("ds").alias("a"), F.max("ds").alias("b"))
    document = F.to_json(F.struct("total", F.struct(F.col("a").alias("start"), F.col("b").alias("end")).alias("range")))
    return sums.select("location", document.alias("document"))
