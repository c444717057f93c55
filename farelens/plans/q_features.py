"""Row-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelens.constants import (BOOKING_BANDS, BUDGET_AIRLINES_NOTEBOOK, DURATION_HOUR_BANDS, SEASONS,
                                SEASON_CODES, SLOT_HOURS)
from farelens.functions.dates import season_code
from farelens.operators import features as Fe
from farelens.operators.enrich import enrich_fares
from farelens.plans import base
from farelens.plans.oracle import _in, _map_case, band_case, with_ctes
from farelens.operators.stats import materialize
from farelens.plans.registry import query
from farelens.sources import tables

PARTS = ["year", "month", "quarter", "day", "day_of_week", "day_of_year", "week_of_year"]


@query("date_parts", with_ctes(f"SELECT fare_key, date, {', '.join(PARTS)} FROM temporal", "temporal"))
def date_parts(spark, d):
    return Fe.temporal_features(base.fares(spark, d)).select("fare_key", "date", *PARTS)


_CODES = {m: SEASON_CODES[s] for m, s in SEASONS.items()}


@query("season", with_ctes(f"SELECT fare_key, month, season, {_map_case('month', _CODES, 0)} AS season_code "
                           "FROM temporal", "temporal"))
def season(spark, d):
    out = Fe.temporal_features(base.fares(spark, d))
    return out.select("fare_key", "month", "season", season_code(F.col("month")).alias("season_code"))


@query("weekend_month_end", with_ctes("SELECT fare_key, is_weekend, is_month_end FROM temporal", "temporal"))
def weekend_month_end(spark, d):
    return Fe.temporal_features(base.fares(spark, d)).select("fare_key", "is_weekend", "is_month_end")


ROUTE_COLS = ["fare_key", "from", "to", "from_major_city", "to_major_city", "major_to_major", "route_type"]


@query("major_city_flags", with_ctes(f"SELECT {', '.join(chr(34) + c + chr(34) for c in ROUTE_COLS)} FROM rest",
                                     "rest"))
def major_city_flags(spark, d):
    return Fe.route_features(base.fares(spark, d)).select(*ROUTE_COLS)


@query("route_popularity", with_ctes('SELECT fare_key, "from", "to", route_popularity FROM rest', "rest"))
def route_popularity(spark, d):
    fares = materialize(base.fares(spark, d).select("fare_key", "from", "to"), "routes")
    return Fe.group_count(fares, ["from", "to"], "route_popularity").select(
        "fare_key", "from", "to", "route_popularity")


@query("airline_frequency", with_ctes("""
SELECT fare_key, airline,
       CASE WHEN airline IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY airline) END AS airline_market_share
FROM fares_dirty""", "fares_dirty"))
def airline_frequency(spark, d):
    return Fe.airline_features(base.fares_dirty(spark, d)).select("fare_key", "airline", "airline_market_share")


@query("carrier_share", with_ctes("""
SELECT fare_key, airline, CASE WHEN airline IS NOT NULL
         THEN CAST(count(*) OVER (PARTITION BY airline) AS DOUBLE) / CAST(count(airline) OVER () AS DOUBLE) END AS airline_share
FROM fares_dirty""", "fares_dirty"))
def carrier_share(spark, d):
    """J6 as a share of the rows that have a carrier."""
    return Fe.airline_features(base.fares_dirty(spark, d), share=True).select("fare_key", "airline", "airline_share")


@query("group_count_over", with_ctes("""
SELECT fare_key, class, stop, count(*) OVER (PARTITION BY class, stop) AS n_same_cabin_stops FROM fares""", "fares"))
def group_count_over(spark, d):
    return Fe.group_count(base.fares(spark, d), ["class", "stop"], "n_same_cabin_stops").select(
        "fare_key", "class", "stop", "n_same_cabin_stops")


SLOT_COLS = ["fare_key", "dep_time", "arr_time", "dep_time_slot", "arr_time_slot", "is_peak_departure"]


@query("time_slots", with_ctes(f"SELECT {', '.join(SLOT_COLS)} FROM rest", "rest"))
def time_slots(spark, d):
    return Fe.time_features(base.standardized(spark, d)).select(*SLOT_COLS)


DUR_COLS = ["fare_key", "time_taken", "flight_hours", "flight_minutes", "total_flight_minutes", "duration_category"]


@query("duration_features", with_ctes(f"SELECT {', '.join(DUR_COLS)} FROM rest", "rest"))
def duration_features(spark, d):
    return Fe.duration_features(base.standardized(spark, d)).select(*DUR_COLS)


@query("airline_type", with_ctes("SELECT fare_key, airline, airline_type FROM rest", "rest"))
def airline_type(spark, d):
    return Fe.airline_features(base.fares(spark, d)).select("fare_key", "airline", "airline_type")


@query("route_key", with_ctes("""
SELECT fare_key, source_city, destination_city, concat_ws('_', source_city, destination_city) AS route
FROM clean_file""", "clean_file"))
def route_key(spark, d):
    return Fe.route_key(tables.clean_file(spark, d)).select("fare_key", "source_city", "destination_city", "route")


@query("hour_of_slot", with_ctes(f"""
SELECT fare_key, departure_time, arrival_time, {_map_case('departure_time', SLOT_HOURS)} AS departure_hour,
       {_map_case('arrival_time', SLOT_HOURS)} AS arrival_hour FROM clean_file""", "clean_file"))
def hour_of_slot(spark, d):
    return Fe.hour_of_slot(tables.clean_file(spark, d)).select(
        "fare_key", "departure_time", "arrival_time", "departure_hour", "arrival_hour")


@query("fare_flags", with_ctes(f"""
SELECT fare_key, CAST(coalesce({_in('airline', BUDGET_AIRLINES_NOTEBOOK)}, FALSE) AS INTEGER) AS is_budget_airline,
       CAST(coalesce(stops <> 'zero', TRUE) AS INTEGER) AS has_stops,
       CAST(coalesce(class = 'Business', FALSE) AS INTEGER) AS is_premium_class,
       CAST(coalesce(days_left <= 7, FALSE) AS INTEGER) AS is_last_minute
FROM clean_file""", "clean_file"))
def fare_flags(spark, d):
    return Fe.fare_flags(tables.clean_file(spark, d)).select(
        "fare_key", "is_budget_airline", "has_stops", "is_premium_class", "is_last_minute")


@query("booking_band", with_ctes(f"""
SELECT fare_key, days_left, {band_case('days_left', BOOKING_BANDS)} AS booking_category FROM clean_file""",
                                 "clean_file"))
def booking_band(spark, d):
    return Fe.booking_band(tables.clean_file(spark, d)).select("fare_key", "days_left", "booking_category")


@query("duration_band_hours", with_ctes(f"""
SELECT fare_key, duration, {band_case('duration', DURATION_HOUR_BANDS)} AS duration_category FROM clean_file""",
                                        "clean_file"))
def duration_band_hours(spark, d):
    return Fe.duration_band_hours(tables.clean_file(spark, d)).select("fare_key", "duration", "duration_category")


def feature_table(spark, d, extra=()):
    """F13 over the standardised fares (written once: the counts and the rows read them), with the external tables."""
    series, cal = base.series(spark, d), base.calendar(spark)
    fares = materialize(base.standardized(spark, d, extra), "standardized")
    return Fe.feature_engineering(fares, enrich=lambda df: enrich_fares(df, series, cal))


@query("feature_chain", with_ctes("SELECT * FROM feat", "feat"))
def feature_chain(spark, d):
    return feature_table(spark, d)
