"""Standardising and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelens.constants import TIME_LABEL_FIXES
from farelens.operators import clean as P
from farelens.plans import base
from farelens.plans.oracle import with_ctes
from farelens.operators.stats import materialize
from farelens.plans.registry import query
from farelens.sources import tables


def _relabel_sql(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TIME_LABEL_FIXES.items())
    return f"coalesce(CASE {col} {whens} END, {col})"


DURATION_TEXT = ("printf('%dh %02dm', CAST(floor(duration) AS BIGINT), "
                 "CAST(floor((duration - floor(duration)) * 60) AS BIGINT))")


@query("rename_columns", with_ctes("""
SELECT fare_key, source_city AS "from", destination_city AS "to", departure_time AS dep_time,
       arrival_time AS arr_time, stops AS stop FROM clean_file""", "clean_file"))
def rename_columns(spark, d):
    return P.rename_columns(tables.clean_file(spark, d)).select("fare_key", "from", "to", "dep_time", "arr_time", "stop")


@query("date_from_days_left", with_ctes("""
SELECT fare_key, days_left, CAST(DATE '2024-01-01' + days_left AS DATE) AS date FROM clean_file""", "clean_file"))
def date_from_days_left(spark, d):
    return P.date_from_days_left(tables.clean_file(spark, d)).select("fare_key", "days_left", "date")


@query("carrier_code", with_ctes("SELECT fare_key, airline, substring(airline, 1, 2) AS ch_code FROM clean_file",
                                 "clean_file"))
def carrier_code(spark, d):
    return P.add_carrier_code(tables.clean_file(spark, d)).select("fare_key", "airline", "ch_code")


@query("flight_number", with_ctes("""
SELECT fare_key, flight, coalesce(nullif(regexp_extract(flight, '(\\d+)', 1), ''), '000') AS num_code
FROM clean_file""", "clean_file"))
def flight_number(spark, d):
    return P.add_flight_number(tables.clean_file(spark, d)).select("fare_key", "flight", "num_code")


@query("format_duration", with_ctes(f"""
SELECT fare_key, duration, coalesce({DURATION_TEXT}, '2h 00m') AS time_taken FROM clean_file""", "clean_file"))
def format_duration(spark, d):
    return P.add_time_taken(tables.clean_file(spark, d)).select("fare_key", "duration", "time_taken")


@query("parse_dmy_date", with_ctes("""
SELECT fare_key, ggldate AS date_text, CAST(try_strptime(ggldate, '%d-%m-%Y') AS DATE) AS date FROM business_file
UNION ALL
SELECT fare_key, date AS date_text, CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date FROM economy_file""",
                                   "business_file", "economy_file"))
def parse_dmy_date(spark, d):
    business = tables.business_file(spark, d).select("fare_key", F.col("ggldate").alias("date_text"))
    economy = tables.economy_file(spark, d).select("fare_key", F.col("date").alias("date_text"))
    return P.parse_dates(business.unionAll(economy), "date_text").select("fare_key", "date_text", "date")


@query("parse_price_text", with_ctes("""
SELECT fare_key, price AS price_text, TRY_CAST(regexp_replace(price, '[,"]', '', 'g') AS DOUBLE) AS price
FROM business_file
UNION ALL
SELECT fare_key, price, TRY_CAST(regexp_replace(price, '[,"]', '', 'g') AS DOUBLE) FROM economy_file""",
                                     "business_file", "economy_file"))
def parse_price_text(spark, d):
    b = tables.business_file(spark, d)
    e = tables.economy_file(spark, d)
    return (P.parse_price(b.withColumnRenamed("price", "price_text"), "price_text", "price")
            .select("fare_key", "price_text", "price")
            .unionByName(P.parse_price(e.withColumnRenamed("price", "price_text"), "price_text", "price")
                         .select("fare_key", "price_text", "price")))


@query("default_class", with_ctes("""
SELECT fare_key, 'Business' AS class FROM business_file UNION ALL SELECT fare_key, 'Economy' FROM economy_file""",
                                  "business_file", "economy_file"))
def default_class(spark, d):
    b = P.standardize_business(tables.business_file(spark, d)).select("fare_key", "class")
    e = P.standardize_economy(tables.economy_file(spark, d)).select("fare_key", "class")
    return b.unionByName(e)


UNION_SQL = with_ctes(f"""
SELECT fare_key, airline, flight, source_city AS "from", destination_city AS "to", departure_time AS dep_time,
       arrival_time AS arr_time, stops AS stop, class, duration, days_left, price,
       CAST(DATE '2024-01-01' + days_left AS DATE) AS date, substring(airline, 1, 2) AS ch_code,
       coalesce(nullif(regexp_extract(flight, '(\\d+)', 1), ''), '000') AS num_code,
       coalesce({DURATION_TEXT}, '2h 00m') AS time_taken, CAST(NULL AS VARCHAR) AS ggldate
FROM clean_file
UNION ALL BY NAME
SELECT fare_key, airline, ch_code, num_code, "from", "to", stop, dep_time, arr_time, time_taken, ggldate,
       TRY_CAST(regexp_replace(price, '[,"]', '', 'g') AS DOUBLE) AS price,
       CAST(try_strptime(ggldate, '%d-%m-%Y') AS DATE) AS date, 'Business' AS class
FROM business_file
UNION ALL BY NAME
SELECT fare_key, airline, ch_code, num_code, "from", "to", stop, dep_time, arr_time, time_taken,
       TRY_CAST(regexp_replace(price, '[,"]', '', 'g') AS DOUBLE) AS price,
       CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, 'Economy' AS class
FROM economy_file""", "clean_file", "business_file", "economy_file")


@query("union_fares", UNION_SQL)
def union_fares(spark, d):
    return base.standard_union(spark, d)


@query("clean_price", with_ctes("""
SELECT fare_key, CASE WHEN p < 1000 THEN p * 1000 ELSE p END AS price
FROM (SELECT fare_key, TRY_CAST(regexp_replace(price_text, '[^0-9.]', '', 'g') AS DOUBLE) AS p FROM fares_dirty)
WHERE p > 0""", "fares_dirty"))
def clean_price(spark, d):
    return P.clean_price(base.fares_dirty(spark, d), source="price_text").select("fare_key", "price")


@query("clean_time_label", with_ctes(f"""
SELECT fare_key, {_relabel_sql('dep_time')} AS dep_time, {_relabel_sql('arr_time')} AS arr_time FROM fares""",
                                     "fares"))
def clean_time_label(spark, d):
    return P.clean_time_labels(base.fares(spark, d)).select("fare_key", "dep_time", "arr_time")


IQR_SQL = """
SELECT event_id, value FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) b
WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)"""


@query("iqr_filter", IQR_SQL)
def iqr_filter(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "value")
    return P.iqr_filter(ev, "value")


@query("drop_duplicates", with_ctes("SELECT DISTINCT * FROM fares_dirty", "fares_dirty"))
def drop_duplicates(spark, d):
    return P.drop_duplicates(base.fares_dirty(spark, d))


def _mode_sql(col: str, src: str) -> str:
    return (f'(SELECT v FROM (SELECT {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}) '
            f'ORDER BY n DESC, v LIMIT 1)')


MODE_COLS = ["airline", "from", "to", "class", "stop"]


@query("fill_mode", with_ctes("SELECT fare_key, " + ", ".join(
    f'coalesce("{c}", {_mode_sql(chr(34) + c + chr(34), "fares_dirty")}) AS "{c}"' for c in MODE_COLS)
    + " FROM fares_dirty", "fares_dirty"))
def fill_mode(spark, d):
    df = materialize(base.fares_dirty(spark, d).select("fare_key", *MODE_COLS), "dirty")
    fills = P.fit_fill_values(df, mode_cols=MODE_COLS, median_cols=())
    return P.fill_missing(df, fills, constant_cols=()).select("fare_key", *MODE_COLS)


@query("fill_median", with_ctes("""
SELECT fare_key, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM fares_dirty)) AS price,
       coalesce(duration, (SELECT quantile_cont(duration, 0.5) FROM fares_dirty)) AS duration
FROM fares_dirty""", "fares_dirty"))
def fill_median(spark, d):
    df = materialize(base.fares_dirty(spark, d).select("fare_key", "price", "duration"), "dirty")
    fills = P.fit_fill_values(df, mode_cols=(), median_cols=("price", "duration"))
    return P.fill_missing(df, fills, constant_cols=()).select("fare_key", "price", "duration")


@query("fill_constant", with_ctes("""
SELECT fare_key, coalesce(dep_time, 'Unknown') AS dep_time, coalesce(arr_time, 'Unknown') AS arr_time
FROM fares_dirty""", "fares_dirty"))
def fill_constant(spark, d):
    return P.fill_missing(base.fares_dirty(spark, d), {}).select("fare_key", "dep_time", "arr_time")


CLEAN_SQL = with_ctes(f"""
SELECT * FROM labelled, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM labelled) b
WHERE price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)""", "fares_dirty", extra={
    "dedup": "SELECT DISTINCT * FROM fares_dirty",
    "filled": "SELECT * REPLACE (" + ", ".join(
        [f'coalesce("{c}", {_mode_sql(chr(34) + c + chr(34), "dedup")}) AS "{c}"' for c in MODE_COLS]
        + ["coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dedup)) AS price",
           "coalesce(duration, (SELECT quantile_cont(duration, 0.5) FROM dedup)) AS duration",
           "coalesce(dep_time, 'Unknown') AS dep_time", "coalesce(arr_time, 'Unknown') AS arr_time"]) + ") FROM dedup",
    "priced": """SELECT * REPLACE (CASE WHEN p < 1000 THEN p * 1000 ELSE p END AS price) FROM (
        SELECT *, TRY_CAST(regexp_replace(price_text, '[^0-9.]', '', 'g') AS DOUBLE) AS p FROM filled) WHERE p > 0""",
    "labelled": f"""SELECT * EXCLUDE (p) REPLACE ({_relabel_sql('dep_time')} AS dep_time,
        {_relabel_sql('arr_time')} AS arr_time) FROM priced""",
}).replace("SELECT * FROM labelled, (", "SELECT labelled.* FROM labelled, (")


@query("clean_fares", CLEAN_SQL)
def clean_fares(spark, d):
    return P.clean_fares(base.fares_dirty(spark, d), price_source="price_text")


def _counted(steps: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"""SELECT CAST({i} AS INTEGER) AS position, '{step}' AS step, a.n AS rows_in, b.n AS rows_out, a.n - b.n AS removed
        FROM (SELECT count(*) AS n FROM {before}) a, (SELECT count(*) AS n FROM {after}) b""" for i, (step, before, after) in enumerate(steps, 1))


_CUT = CLEAN_SQL.index("SELECT labelled.* FROM labelled")


@query("clean_counts", CLEAN_SQL[:_CUT].rstrip() + f""", kept AS ({CLEAN_SQL[_CUT:]})
""" + _counted([("duplicates", "fares_dirty", "dedup"), ("price", "dedup", "priced"), ("outliers", "labelled", "kept")]))
def clean_counts(spark, d):
    """Rows before and after each cleaning step, observed while the table is cleaned and written."""
    counts = P.StepCounts()
    materialize(P.clean_fares(base.fares_dirty(spark, d), price_source="price_text", counts=counts), "clean")
    return counts.table(spark)
