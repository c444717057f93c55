"""Sources, enrichment joins and the monthly report."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelens.operators import analytics as A
from farelens.operators import enrich as J
from farelens.plans import base
from farelens.plans.oracle import mean_cents, with_ctes
from farelens.plans.registry import query

PRICE_STATS = f"""{mean_cents()} AS mean_price, round(stddev_samp(price), 2) AS std_price, count(price) AS n"""

SQL_SCAN_FARES = with_ctes("SELECT * FROM fares", "fares")

SQL_SCAN_DAILY_SERIES = with_ctes("SELECT * FROM fuel", "fuel")

SQL_JOIN_DAILY_SERIES = with_ctes("""
SELECT f.fare_key, f.date, fu.fuel_price_usd_per_barrel, fu.fuel_price_inr_per_liter
FROM fares f LEFT JOIN fuel fu ON f.date = fu.date""", "fares", "fuel")

SQL_HOLIDAY_EXACT = with_ctes("""
SELECT f.fare_key, f.date, hd.hd IS NOT NULL AS is_holiday, coalesce(hd.score, 0.0) AS holiday_impact_score,
       hd.holiday_name
FROM fares f LEFT JOIN hol_day hd ON f.date = hd.hd""", "fares", "hol_day")

SQL_HOLIDAY_WINDOW = with_ctes("""
SELECT f.fare_key, f.date, hw.day IS NOT NULL AS is_holiday_season, hw.days_to_holiday, hw.season_holiday_name,
       hw.holiday_impact,
       CASE WHEN hw.day IS NULL THEN NULL WHEN hw.days_to_holiday > 0 THEN 'pre_holiday' ELSE 'post_holiday' END
         AS season_type
FROM fares f LEFT JOIN hol_win hw ON f.date = hw.day""", "fares", "hol_win")

SQL_NEAREST_DATE = with_ctes("""
SELECT f.fare_key, f.date, n.nearest_date, n.fuel_price_usd_per_barrel
FROM fares f LEFT JOIN (
  SELECT d.date, arg_min(fu.date, (abs(date_diff('day', d.date, fu.date)), fu.date)) AS nearest_date,
         arg_min(fu.fuel_price_usd_per_barrel, (abs(date_diff('day', d.date, fu.date)), fu.date))
           AS fuel_price_usd_per_barrel
  FROM (SELECT DISTINCT date FROM fares) d, fuel fu GROUP BY d.date) n ON f.date = n.date""", "fares", "fuel")

SQL_ENRICH_FARES = with_ctes("SELECT * FROM enriched", "enriched")

SQL_MONTHLY_STATS = with_ctes(f"""
SELECT route, CAST(month(date) AS INTEGER) AS month, {PRICE_STATS}
FROM enriched GROUP BY route, month(date)""", "enriched")

SQL_PEAK_MONTHS = with_ctes("""
SELECT route, kind, CAST(rank AS INTEGER) AS rank, month, mean_price FROM (
  SELECT route, 'peak' AS kind, row_number() OVER (PARTITION BY route ORDER BY mean_price DESC, month) AS rank,
         month, mean_price FROM m
  UNION ALL
  SELECT route, 'off_peak', row_number() OVER (PARTITION BY route ORDER BY mean_price ASC, month), month, mean_price
  FROM m) WHERE rank <= 3""", "enriched", extra={"m": f"""
  SELECT route, CAST(month(date) AS INTEGER) AS month, {mean_cents()} AS mean_price FROM enriched
  GROUP BY route, month(date)"""})

# ---------------------------------------------------------------- sources / joins
@query("scan_fares", SQL_SCAN_FARES)
def scan_fares(spark, d):
    return base.fares(spark, d)


@query("scan_daily_series", SQL_SCAN_DAILY_SERIES)
def scan_daily_series(spark, d):
    return base.series(spark, d)


@query("join_daily_series", SQL_JOIN_DAILY_SERIES)
def join_daily_series(spark, d):
    out = J.join_daily_series(base.fares(spark, d), base.series(spark, d))
    return out.select("fare_key", "date", "fuel_price_usd_per_barrel", "fuel_price_inr_per_liter")


@query("holiday_exact", SQL_HOLIDAY_EXACT)
def holiday_exact(spark, d):
    out = J.holiday_exact(base.fares(spark, d), base.calendar(spark))
    return out.select("fare_key", "date", "is_holiday", "holiday_impact_score", "holiday_name")


@query("holiday_window", SQL_HOLIDAY_WINDOW)
def holiday_window(spark, d):
    out = J.holiday_window(base.fares(spark, d), base.calendar(spark))
    return out.select("fare_key", "date", "is_holiday_season", "days_to_holiday", "season_holiday_name",
                      "holiday_impact", "season_type")


@query("holiday_nearest", with_ctes("""
SELECT f.fare_key, h.days_to_holiday, h.holiday_name AS season_holiday_name FROM fares f LEFT JOIN (
  SELECT day, arg_min(days_to_holiday, (abs(days_to_holiday), -days_to_holiday, seq)) AS days_to_holiday,
         arg_min(holiday_name, (abs(days_to_holiday), -days_to_holiday, seq)) AS holiday_name
  FROM (SELECT c.seq, CAST(c.date + CAST(r.k AS INTEGER) AS DATE) AS day, CAST(-r.k AS INTEGER) AS days_to_holiday, c.holiday_name
        FROM cal c, range(-7, 8) r(k)) GROUP BY day) h ON h.day = f.date""", "fares", "cal"))
def holiday_nearest(spark, d):
    """J3 with the nearest holiday of the window in place of the first in calendar order."""
    out = J.holiday_window(base.fares(spark, d), base.calendar(spark), pick="nearest")
    return out.select("fare_key", "days_to_holiday", "season_holiday_name")


@query("nearest_date", SQL_NEAREST_DATE)
def nearest_date(spark, d):
    out = J.nearest_date(base.fares(spark, d), base.series(spark, d))
    return out.select("fare_key", "date", "nearest_date", "fuel_price_usd_per_barrel")


@query("enrich_fares", SQL_ENRICH_FARES)
def enrich_fares(spark, d):
    return base.enriched(spark, d)


# ---------------------------------------------------------------- analytics
@query("monthly_stats", SQL_MONTHLY_STATS)
def monthly_stats(spark, d):
    return A.monthly_stats(base.enriched(spark, d))


@query("peak_months", SQL_PEAK_MONTHS)
def peak_months(spark, d):
    return A.peak_months(A.monthly_stats(base.enriched(spark, d)))
