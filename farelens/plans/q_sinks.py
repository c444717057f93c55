"""Calendar, spine, stored-table and preparation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from farelens.constants import CATEGORICAL_FEATURES
from farelens.operators import encode as M
from farelens.plans import base
from farelens.plans.oracle import CTES, with_ctes
from farelens.plans.q_clean import CLEAN_SQL
from farelens.plans.q_matrix import MATRIX, MATRIX_CTES, fitted
from farelens.plans.registry import query
from farelens.session import scratch_path
from farelens.sources import files, tables
from farelens.sources.calendar import build_calendar, score_holidays, spine_from_range, union_calendars

_TWO_PI = repr(2 * math.pi)


@query("date_spine", with_ctes(f"""
SELECT date, round(p, 2) AS fuel_price_usd_per_barrel, round(p * 0.53, 2) AS fuel_price_inr_per_liter
FROM (SELECT date, 100.0 * (1.0 + 0.1 * sin({_TWO_PI} * dayofyear(date) / 365.0))
                   * (1.0 + 0.0001 * date_diff('day', s, date))
                   * CASE WHEN year(date) = 2020 AND month(date) BETWEEN 3 AND 6 THEN 0.7
                          WHEN year(date) = 2022 AND month(date) >= 3 THEN 1.3 ELSE 1.0 END AS p
      FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date, min(date) AS s
            FROM fares))""", "fares"))
def date_spine(spark, d):
    bounds = base.fares(spark, d).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return spine_from_range(bounds)


def _fare_years(spark, d):
    """Years with fares, from the one column that holds the date (no fare join)."""
    return tables.table(spark, d, "lineitem", "l_shipdate").select(F.year(F.to_date("l_shipdate")).alias("year")).distinct()


CAL_COLS = ["seq", "date", "holiday_name", "is_national_holiday", "holiday_type", "year", "holiday_impact_score"]


@query("build_calendar", with_ctes("""
SELECT seq, date, holiday_name, is_national_holiday, holiday_type, year, holiday_impact_score FROM cal
WHERE year IN (SELECT DISTINCT CAST(year(date) AS INTEGER) FROM fares)""", "fares", "cal"))
def build_calendar_q(spark, d):
    return build_calendar(spark).join(_fare_years(spark, d), "year", "left_semi").select(*CAL_COLS)


@query("scan_calendar", with_ctes("""
SELECT date, holiday_name, is_national_holiday, holiday_type, year, holiday_impact_score FROM cal
WHERE year IN (SELECT DISTINCT CAST(year(date) AS INTEGER) FROM fares)""", "fares", "cal"))
def scan_calendar(spark, d):
    """S3: the calendar of the fares' years, written as the holiday file and read back with its schema."""
    path = scratch_path(spark, "calendar-csv")
    cols = [f.name for f in files.CALENDAR_FILE_SCHEMA.fields]
    build_calendar_q(spark, d).select(*cols).write.option("header", True).csv(path)
    return files.read_calendar(spark, path).select(*cols)


@query("union_calendar", with_ctes("""
SELECT holiday_type, count(*) AS n FROM cal
WHERE year IN (SELECT DISTINCT CAST(year(date) AS INTEGER) FROM fares) GROUP BY holiday_type""", "fares", "cal"))
def union_calendar(spark, d):
    cal = build_calendar(spark).join(_fare_years(spark, d), "year", "left_semi")
    national = cal.where(F.col("is_national_holiday"))
    festival = cal.where(~F.col("is_national_holiday"))
    return national.unionByName(festival).groupBy("holiday_type").agg(F.count(F.lit(1)).alias("n"))


@query("impact_lookup", with_ctes("""
SELECT DISTINCT holiday_name, holiday_impact_score FROM cal
WHERE year IN (SELECT DISTINCT CAST(year(date) AS INTEGER) FROM fares)""", "fares", "cal"))
def impact_lookup(spark, d):
    cal = build_calendar(spark).join(_fare_years(spark, d), "year", "left_semi")
    return cal.select("holiday_name", "holiday_impact_score").distinct()


# ---------------------------------------------------------------- the calendar as an input: two files, two date forms, bad rows
PEAK_SCORES = {"1-URGENT": 5.0, "2-HIGH": 4.0}


def _peak_days(spark, d):
    """One "holiday" a quarter: the day of the largest order, named after its priority (some dozens of rows)."""
    o = tables.table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    day = F.to_date("o_orderdate")
    top = o.groupBy(F.year(day).alias("year"), F.quarter(day).alias("q")).agg(
        F.max_by(F.struct(day.alias("day"), F.col("o_orderpriority").alias("name")), F.struct("o_totalprice", "o_orderkey")).alias("t"))
    text = F.col("t.day").cast("string")
    form = F.when(F.col("q") == 4, F.concat(F.lit("day of "), F.col("year"))).when(F.col("q") == 2, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    return top.select("q", form.alias("date"), F.col("t.name").alias("holiday_name"), (F.col("q") % 2 == 1).alias("is_national_holiday"),
                      F.when(F.col("q") % 2 == 1, "National").otherwise("Regional").alias("holiday_type"), "year",
                      F.lit(0.0).alias("holiday_impact_score"))


def _calendar_folder(spark, d) -> str:
    """The two holiday files, in the order of year and quarter; the last quarter's date is malformed."""
    path, days = scratch_path(spark, "holiday-files"), _peak_days(spark, d)
    names = [f.name for f in files.CALENDAR_FILE_SCHEMA.fields]
    for kind, national in (("national", True), ("regional", False)):
        days.where(F.col("is_national_holiday") == F.lit(national)).orderBy("year", "q").coalesce(1).select(*names).write.option(
            "header", True).csv(f"{path}/{kind}")
    return path


PEAK_CTE = {"peak": """
  SELECT year, q, t.day AS date, t.name AS holiday_name, q % 2 = 1 AS is_national_holiday,
         CASE WHEN q % 2 = 1 THEN 'National' ELSE 'Regional' END AS holiday_type
  FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, quarter(o_orderdate) AS q,
               arg_max(struct_pack(day := CAST(o_orderdate AS DATE), name := o_orderpriority), (o_totalprice, o_orderkey)) AS t
        FROM orders GROUP BY 1, 2)"""}


@query("calendar_files", with_ctes(f"""
SELECT CAST(row_number() OVER (ORDER BY is_national_holiday DESC, year, q) - 1 AS INTEGER) AS seq, date, holiday_name, is_national_holiday,
       holiday_type, year, CASE holiday_name {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PEAK_SCORES.items())} ELSE 3.0 END AS holiday_impact_score
FROM peak WHERE q <> 4""", extra=PEAK_CTE))
def calendar_files(spark, d):
    """Both holiday files read in file order, stacked and scored by name."""
    path = _calendar_folder(spark, d)
    cal = union_calendars(*[files.read_calendar(spark, f"{path}/{kind}") for kind in ("national", "regional")])
    scores = spark.createDataFrame(sorted(PEAK_SCORES.items()), "holiday_name string, score double")
    return score_holidays(cal, scores).select(*CAL_COLS)


@query("calendar_rejects", with_ctes("""
SELECT CAST(row_number() OVER (PARTITION BY is_national_holiday ORDER BY year, q) AS INTEGER) AS line, holiday_type,
       'day of ' || year || ',' || holiday_name || ',' || is_national_holiday || ',' || holiday_type || ',' || year || ',0.0' AS text
FROM peak QUALIFY q = 4""", extra=PEAK_CTE))
def calendar_rejects(spark, d):
    """S3: the malformed rows of both files, with the line they stand on."""
    path = _calendar_folder(spark, d)
    parts = [files.rejected_rows(spark, f"{path}/{kind}").withColumn("holiday_type", F.lit(kind.capitalize())) for kind in ("national", "regional")]
    return parts[0].unionByName(parts[1]).select("line", "holiday_type", "text")


@query("read_or_build", with_ctes("SELECT * FROM fuel", "fuel"))
def read_or_build(spark, d):
    path = scratch_path(spark, "daily-index")
    first = files.read_or_build(spark, path, lambda: base.series(spark, d))
    # a second call finds the stored table and does not rebuild it
    return files.read_or_build(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("rebuilt"))).select(
        *first.columns)


@query("external_tables", with_ctes("""
SELECT 'daily_series' AS name, count(*) AS n FROM fuel
UNION ALL
SELECT 'holiday_calendar', count(*) FROM cal WHERE year IN (SELECT DISTINCT CAST(year(date) AS INTEGER) FROM fares)""",
                                    "fares", "fuel", "cal"))
def external_tables(spark, d):
    tables = {"daily_series": base.series(spark, d),
              "holiday_calendar": build_calendar(spark).join(_fare_years(spark, d), "year", "left_semi")}
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    return parts[0].unionByName(parts[1])


@query("external_rows", with_ctes(f"""
SELECT 'daily_series' AS name, date, fuel_price_usd_per_barrel AS value FROM fuel
UNION ALL
SELECT 'holiday_calendar', date, CASE holiday_name {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PEAK_SCORES.items())} ELSE 3.0 END
FROM peak WHERE q <> 4""", "fuel", extra=PEAK_CTE))
def external_rows(spark, d):
    """Both external tables, the daily series and the calendar read from its files, row by row."""
    series = base.series(spark, d).select(F.lit("daily_series").alias("name"), "date", F.col("fuel_price_usd_per_barrel").alias("value"))
    cal = calendar_files(spark, d).select(F.lit("holiday_calendar").alias("name"), "date", F.col("holiday_impact_score").alias("value"))
    return series.unionByName(cal)


@query("write_splits", with_ctes("""
SELECT CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split, count(*) AS n
FROM (SELECT CAST(('0x' || substr(md5(fare_key), 1, 8)) AS BIGINT) % 100 AS b FROM fares) GROUP BY 1""", "fares"))
def write_splits(spark, d):
    out = files.write_splits(M.split_rows(base.fares(spark, d)), scratch_path(spark, "splits"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("save_load_prep", with_ctes("SELECT * FROM scaled", "feat", extra=MATRIX_CTES))
def save_load_prep(spark, d):
    """Fit all columns, save the state, load it back and score the whole table with it."""
    feats, state = fitted(spark, d)
    path = scratch_path(spark, "prep-state")
    files.save_matrix_state(spark, path, state)
    return M.transform_matrix(feats, files.load_matrix_state(spark, path))


@query("prepare_fares", f"""
SELECT CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split, count(*) AS n
FROM (SELECT CAST(('0x' || substr(md5(fare_key), 1, 8)) AS BIGINT) % 100 AS b FROM ({CLEAN_SQL}) c) GROUP BY 1""")
def prepare_fares(spark, d):
    """M6 over the dirty fare table: the written, split, scaled feature matrix (row counts per split)."""
    from farelens.plans.prep import prepare
    out = prepare(spark, base.fares_dirty(spark, d), base.series(spark, d), base.calendar(spark),
                  price_source="price_text")
    return out["table"].groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_PREPARED = with_ctes("SELECT s.*, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, "
                      "CAST(('0x' || substr(md5(fare_key), 1, 8)) AS BIGINT) % 100 AS b FROM scaled) t JOIN scaled s USING (fare_key)", "feat",
                      extra=MATRIX_CTES).replace(f"fares AS ({CTES['fares']})", f"fares AS ({CLEAN_SQL})")


@query("prepared_matrix", _PREPARED)
def prepared_matrix(spark, d):
    """M6: the written matrix itself: every column of every row after cleaning, features, encoding, filling and scaling."""
    from farelens.plans.prep import prepare
    out = prepare(spark, base.fares_dirty(spark, d), base.series(spark, d), base.calendar(spark), price_source="price_text")
    return out["table"].select("fare_key", "price", *MATRIX, "split")


__all__ = ["CATEGORICAL_FEATURES"]
