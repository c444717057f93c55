"""Booking optimiser, fuel what-if and multi-model quote queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.constants import LITRE_FACTOR, MAJOR_CITIES, SCENARIO_DEFAULTS, SEASONS, SEASON_CODES
from farelens.functions.money import cents, mean_from_cents, round_binary
from farelens.operators import analytics as A
from farelens.operators import booking as B
from farelens.operators.stats import materialize
from farelens.plans import base
from farelens.plans.oracle import _in, _map_case, mean_cents, with_ctes
from farelens.plans.registry import query

# --- fixed values: request dates of the booking and form queries ------------
DEPARTURES = ("2001-11-21", "2001-12-15", "2002-01-20")
AS_OF = "2001-11-20"
SCENARIO_RANGE = 0.3


def _requests_of(routes: DataFrame) -> DataFrame:
    dates = F.array(*[F.to_date(F.lit(x)) for x in DEPARTURES])
    return A.with_route(routes).withColumn("departure_date", F.explode(dates))


def requests(spark, d) -> DataFrame:
    """Every route of the fare table x the fixed departure dates.

    The distinct route list (one row per route pair) is written once: the
    scenario features read it twice (nearest-date lookup and join back).
    """
    return _requests_of(materialize(base.fares(spark, d).select("from", "to").distinct(), "routes"))


def scenarios(spark, d) -> DataFrame:
    return B.booking_scenarios(requests(spark, d), AS_OF)


def priced_scenarios(spark, d) -> DataFrame:
    """Scenarios priced from the route's month means.

    One pass over the fares sums integer cents by (from, to, route, month),
    at most twelve rows per route, written once. The request list and the
    (route, month) means are both read from it, so the fare join runs once.
    Cent sums re-aggregate exactly.
    """
    agg = materialize(base.enriched(spark, d).groupBy("from", "to", "route", F.month("date").alias("month")).agg(
        F.sum(cents(F.col("price"))).alias("_s"), F.count("price").alias("_n")), "route-months")
    monthly = agg.groupBy("route", "month").agg(mean_from_cents(F.sum("_s"), F.sum("_n")).alias("mean_price"))
    scen = B.booking_scenarios(_requests_of(agg.select("from", "to").distinct()), AS_OF)
    return B.pattern_price(scen, monthly)


_DEP_VALUES = ", ".join(f"(DATE '{x}')" for x in DEPARTURES)
REQ_CTES = {
    "req": f"""SELECT r.*, d.departure_date FROM (SELECT DISTINCT "from", "to", "from" || '-' || "to" AS route
               FROM fares) r CROSS JOIN (VALUES {_DEP_VALUES}) d(departure_date)""",
    "scen": f"""SELECT req.*, CAST(t.k AS INTEGER) AS days_ahead, CAST(departure_date - CAST(t.k AS INTEGER) AS DATE)
                AS booking_date FROM req, range(1, 91, 7) t(k)
                WHERE departure_date - CAST(t.k AS INTEGER) >= DATE '{AS_OF}'""",
    "mm": f"""SELECT route, month(date) AS month, {mean_cents()} AS mean_price FROM enriched GROUP BY route, month(date)""",
    "priced": """SELECT s.*, CASE WHEN kr.route IS NULL THEN 7000.0 ELSE
                   CASE WHEN s.days_ahead <= 7 THEN bs * 1.2 WHEN s.days_ahead <= 14 THEN bs * 1.1
                        WHEN s.days_ahead >= 30 AND s.days_ahead <= 60 THEN bs * 0.9 ELSE bs END END AS predicted_price
                 FROM (SELECT s0.*, CASE WHEN m.mean_price IS NOT NULL THEN 7000.0 * (m.mean_price / 7000.0)
                                         ELSE 7000.0 END AS bs
                       FROM scen s0 LEFT JOIN mm m ON m.route = s0.route AND m.month = month(s0.booking_date)) s
                 LEFT JOIN (SELECT DISTINCT route FROM mm) kr ON kr.route = s.route""",
}
CONF_SQL = """CASE WHEN CAST(days_ahead AS DOUBLE) >= 14 AND CAST(days_ahead AS DOUBLE) <= 60
                THEN 0.8 + 0.2 * (1 - abs(CAST(days_ahead AS DOUBLE) - 37) / 23)
              WHEN CAST(days_ahead AS DOUBLE) < 14 THEN 0.6 + 0.2 * CAST(days_ahead AS DOUBLE) / 14
              ELSE 0.5 + 0.3 * (90 - CAST(days_ahead AS DOUBLE)) / 30 END"""
OPT_SQL = f"""
SELECT route, departure_date, optimal_booking_date, optimal_days_ahead, predicted_lowest_price, confidence_score,
       n_scenarios, trend,
       CASE WHEN optimal_days_ahead <= 7 THEN 'Book immediately!' WHEN optimal_days_ahead <= 14
            THEN 'Book within the next week' WHEN optimal_days_ahead <= 30 THEN 'Book within the next 2-3 weeks'
            ELSE 'You have time to wait for better deals' END
       || ' The optimal booking time is ' || CAST(optimal_days_ahead AS VARCHAR)
       || ' days in advance with a predicted price of ₹' || CAST(CAST(round(predicted_lowest_price, 0) AS BIGINT) AS VARCHAR)
       || '. Confidence: ' || CASE WHEN confidence_score > 0.7 THEN 'high' WHEN confidence_score > 0.5 THEN 'medium'
                                  ELSE 'low' END
       || '. Price trend: ' || trend || '.' AS recommendation
FROM (SELECT route, departure_date,
        arg_min(booking_date, (predicted_price, days_ahead)) AS optimal_booking_date,
        arg_min(days_ahead, (predicted_price, days_ahead)) AS optimal_days_ahead,
        min(predicted_price) AS predicted_lowest_price,
        arg_min({CONF_SQL}, (predicted_price, days_ahead)) AS confidence_score,
        count(*) AS n_scenarios,
        CASE WHEN count(*) <= 1 THEN 'stable'
             WHEN arg_max(predicted_price, days_ahead) > arg_min(predicted_price, days_ahead) THEN 'increasing'
             ELSE 'decreasing' END AS trend
      FROM priced GROUP BY route, departure_date)"""
REQ_NAMES = ("fares", "enriched")


@query("booking_cross", with_ctes("SELECT route, \"from\", \"to\", departure_date, days_ahead, booking_date FROM scen",
                                  *REQ_NAMES, extra={k: REQ_CTES[k] for k in ("req", "scen")}))
def booking_cross(spark, d):
    return scenarios(spark, d).select("route", "from", "to", "departure_date", "days_ahead", "booking_date")


@query("pattern_price", with_ctes("SELECT route, departure_date, days_ahead, booking_date, predicted_price FROM priced",
                                  *REQ_NAMES, extra=REQ_CTES))
def pattern_price(spark, d):
    return priced_scenarios(spark, d).select("route", "departure_date", "days_ahead", "booking_date", "predicted_price")


@query("confidence_score", with_ctes(f"SELECT route, departure_date, days_ahead, {CONF_SQL} AS confidence_score FROM scen",
                                     *REQ_NAMES, extra={k: REQ_CTES[k] for k in ("req", "scen")}))
def confidence_score(spark, d):
    from farelens.functions.scores import confidence_score as conf
    return scenarios(spark, d).select("route", "departure_date", "days_ahead",
                                      conf(F.col("days_ahead")).alias("confidence_score"))


def _optimal(spark, d):
    return B.optimal_booking(priced_scenarios(spark, d)).drop("all_scenarios")


@query("optimal_booking", with_ctes(OPT_SQL, *REQ_NAMES, extra=REQ_CTES))
def optimal_booking(spark, d):
    return _optimal(spark, d)


@query("best_booking_day", with_ctes(
    "SELECT route, departure_date, optimal_booking_date, optimal_days_ahead, predicted_lowest_price FROM (" + OPT_SQL + ")",
    *REQ_NAMES, extra=REQ_CTES))
def best_booking_day(spark, d):
    return _optimal(spark, d).select("route", "departure_date", "optimal_booking_date", "optimal_days_ahead",
                                     "predicted_lowest_price")


@query("first_last_trend", with_ctes("SELECT route, departure_date, trend FROM (" + OPT_SQL + ")",
                                     *REQ_NAMES, extra=REQ_CTES))
def first_last_trend(spark, d):
    return A.first_last_trend(priced_scenarios(spark, d), ["route", "departure_date"], "days_ahead", "predicted_price")


@query("booking_advice_text", with_ctes("SELECT route, departure_date, recommendation FROM (" + OPT_SQL + ")",
                                        *REQ_NAMES, extra=REQ_CTES))
def booking_advice_text(spark, d):
    return _optimal(spark, d).select("route", "departure_date", "recommendation")


# ---------------------------------------------------------------- B1
_SEASON_CODE = {m: SEASON_CODES[s] for m, s in SEASONS.items()}
B1_COLS = ["route", "departure_date", "days_ahead", "booking_date", "year", "month", "quarter", "day", "day_of_week",
           "day_of_year", "week_of_year", "is_weekend", "is_month_end", "days_left", "season_encoded", "is_holiday",
           "holiday_impact_score", "is_holiday_season", "fuel_price_usd_per_barrel", "fuel_price_inr_per_liter",
           "from_major_city", "to_major_city", "major_to_major", *SCENARIO_DEFAULTS]
_DEFAULTS_SQL = ", ".join(f"{v} AS {k}" for k, v in SCENARIO_DEFAULTS.items())
B1_SQL = with_ctes(f"""
SELECT route, departure_date, days_ahead, booking_date,
       CAST(year(booking_date) AS INTEGER) AS year, CAST(month(booking_date) AS INTEGER) AS month,
       CAST(quarter(booking_date) AS INTEGER) AS quarter, CAST(day(booking_date) AS INTEGER) AS day,
       CAST(isodow(booking_date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(booking_date) AS INTEGER) AS day_of_year,
       CAST(weekofyear(booking_date) AS INTEGER) AS week_of_year,
       CAST(isodow(booking_date) - 1 >= 5 AS INTEGER) AS is_weekend, CAST(day(booking_date) >= 25 AS INTEGER) AS is_month_end,
       days_ahead AS days_left, {_map_case('CAST(month(booking_date) AS INTEGER)', _SEASON_CODE, 0)} AS season_encoded,
       CAST(hd.hd IS NOT NULL AS INTEGER) AS is_holiday, coalesce(hd.score, 0.0) AS holiday_impact_score,
       CAST(hw.day IS NOT NULL AS INTEGER) AS is_holiday_season,
       nf.fuel AS fuel_price_usd_per_barrel, nf.fuel * {LITRE_FACTOR} AS fuel_price_inr_per_liter,
       CAST(coalesce({_in('"from"', MAJOR_CITIES)}, FALSE) AS INTEGER) AS from_major_city,
       CAST(coalesce({_in('"to"', MAJOR_CITIES)}, TRUE) AS INTEGER) AS to_major_city,
       CAST(coalesce({_in('"from"', MAJOR_CITIES)}, FALSE) AND coalesce({_in('"to"', MAJOR_CITIES)}, FALSE) AS INTEGER)
         AS major_to_major,
       {_DEFAULTS_SQL}
FROM scen s
LEFT JOIN hol_day hd ON s.booking_date = hd.hd
LEFT JOIN hol_win hw ON s.booking_date = hw.day
LEFT JOIN (SELECT d.date, arg_min(fu.fuel_price_usd_per_barrel, (abs(date_diff('day', d.date, fu.date)), fu.date)) AS fuel
           FROM (SELECT DISTINCT booking_date AS date FROM scen) d, fuel fu GROUP BY d.date) nf ON nf.date = s.booking_date
""", "fares", "fuel", "hol_day", "hol_win", extra={k: REQ_CTES[k] for k in ("req", "scen")})


@query("scenario_features", B1_SQL)
def scenario_features(spark, d):
    out = B.scenario_features(scenarios(spark, d), base.calendar(spark), base.series(spark, d))
    return out.select(*B1_COLS)


# ---------------------------------------------------------------- B2
FORM_SQL = with_ctes(f"""
SELECT route, departure_date AS travel_date, CAST(year(departure_date) AS INTEGER) AS year,
       CAST(month(departure_date) AS INTEGER) AS month, CAST(isodow(departure_date) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(departure_date) - 1 >= 5 AS INTEGER) AS is_weekend,
       nf.fuel AS fuel_price_usd_per_barrel, nf.fuel * {LITRE_FACTOR} AS fuel_price_inr_per_liter,
       0 AS is_holiday, 0 AS holiday_impact_score, 0 AS is_holiday_season,
       0 AS from_major_city, 0 AS to_major_city, 0 AS major_to_major, 1000 AS route_popularity,
       2 AS dep_time_slot, 4 AS arr_time_slot, 1 AS is_peak_departure, 2.5 AS flight_hours,
       2.5 * 60 AS total_flight_minutes, 5000 AS airline_market_share
FROM req r LEFT JOIN (
  SELECT d.date, arg_min(fu.fuel_price_usd_per_barrel, (abs(date_diff('day', d.date, fu.date)), fu.date)) AS fuel
  FROM (SELECT DISTINCT departure_date AS date FROM req) d, fuel fu GROUP BY d.date) nf ON nf.date = r.departure_date
""", "fares", "fuel", extra={"req": REQ_CTES["req"]})
FORM_COLS = ["route", "travel_date", "year", "month", "day_of_week", "is_weekend", "fuel_price_usd_per_barrel",
             "fuel_price_inr_per_liter", "is_holiday", "holiday_impact_score", "is_holiday_season", "from_major_city",
             "to_major_city", "major_to_major", "route_popularity", "dep_time_slot", "arr_time_slot",
             "is_peak_departure", "flight_hours", "total_flight_minutes", "airline_market_share"]


@query("form_features", FORM_SQL)
def form_features(spark, d):
    req = requests(spark, d).withColumnRenamed("departure_date", "travel_date").withColumns(
        {"dep_time": F.lit("Morning"), "duration": F.lit(2.5)})
    return B.form_features(req, base.series(spark, d)).select(*FORM_COLS)


# ---------------------------------------------------------------- B4-B6, J9, K5, K9, A16, A18, F19, F20
FUEL = "fuel_price_usd_per_barrel"


def fuel_base(spark, d) -> DataFrame:
    e = base.enriched(spark, d)
    return e.groupBy("route").agg(round_binary(F.avg(FUEL), 2).alias("base_fuel_price")).where(
        F.col("base_fuel_price").isNotNull())


def route_fuel_table(spark, d) -> DataFrame:
    """Per route, in one pass over the fares: base fuel price and the price-on-fuel line.

    One row per route, written once to the shared checkpoint folder: the
    scenario scoring reads it several times (scenarios, base rows, baseline)
    and must not re-run the fare join for each read.
    """
    e = base.enriched(spark, d)
    t = e.groupBy("route").agg(round_binary(F.avg(FUEL), 2).alias("base_fuel_price"),
                               F.regr_slope("price", FUEL).alias("slope"),
                               F.regr_intercept("price", FUEL).alias("intercept"))
    return materialize(t, "route-fuel")


def fuel_impact_table(spark, d) -> DataFrame:
    t = route_fuel_table(spark, d)
    scorer = B.trend_scorer(t.select("route", "slope", "intercept"))
    fb = t.select("route", "base_fuel_price").where(F.col("base_fuel_price").isNotNull())
    return B.fuel_impact(B.fuel_scenarios(fb, scenario_range=SCENARIO_RANGE), scorer)


_N = int(2 * SCENARIO_RANGE / 0.1 + 1e-9)
FUEL_CTES = {
    "fb": f"SELECT route, round(avg({FUEL}), 2) AS base_fuel_price FROM enriched GROUP BY route "
          f"HAVING round(avg({FUEL}), 2) IS NOT NULL",
    "fs": f"""SELECT route, base_fuel_price,
               round(base_fuel_price * (1.0 + (CAST({-SCENARIO_RANGE} AS DOUBLE) + CAST(0.1 AS DOUBLE) * i)), 2)
                 AS fuel_price
              FROM fb, range(0, {_N + 1}) t(i)""",
    "tm": f"SELECT route, regr_slope(price, {FUEL}) AS slope, regr_intercept(price, {FUEL}) AS intercept "
          f"FROM enriched GROUP BY route",
    "sc": """SELECT fs.route, base_fuel_price, fuel_price, tm.intercept + tm.slope * fuel_price AS predicted_price,
                    tm.intercept + tm.slope * base_fuel_price AS p0,
                    (fuel_price - base_fuel_price) / base_fuel_price AS fchg
             FROM fs LEFT JOIN tm ON tm.route = fs.route""",
    "imp": """SELECT sc.route, base_fuel_price, fuel_price, predicted_price, fchg * 100 AS fuel_change_pct,
                     (predicted_price - bl.baseline_price) / bl.baseline_price * 100 AS price_impact_pct,
                     CASE WHEN fchg <> 0 THEN ((predicted_price - p0) / p0) / fchg ELSE 0.0 END AS elasticity,
                     bl.baseline_price
              FROM sc JOIN (SELECT route, arg_min(predicted_price, (abs(fuel_price - base_fuel_price), fuel_price))
                              AS baseline_price FROM sc GROUP BY route) bl ON bl.route = sc.route""",
}


def _rounded_impact(df: DataFrame) -> DataFrame:
    return df.select("route", "base_fuel_price", "fuel_price", F.round("predicted_price", 4).alias("predicted_price"),
                     F.round("fuel_change_pct", 6).alias("fuel_change_pct"),
                     F.round("price_impact_pct", 6).alias("price_impact_pct"),
                     F.round("elasticity", 6).alias("elasticity"), F.round("baseline_price", 4).alias("baseline_price"))


@query("fuel_scenarios", with_ctes("SELECT route, base_fuel_price, fuel_price FROM fs", "enriched",
                                   extra={k: FUEL_CTES[k] for k in ("fb", "fs")}))
def fuel_scenarios(spark, d):
    return B.fuel_scenarios(fuel_base(spark, d), scenario_range=SCENARIO_RANGE)


@query("scenario_cross", with_ctes(f"""
SELECT route, fuel_price, fuel_price AS fuel_price_usd_per_barrel, fuel_price * {LITRE_FACTOR} AS fuel_price_inr_per_liter
FROM fs""", "enriched", extra={k: FUEL_CTES[k] for k in ("fb", "fs")}))
def scenario_cross(spark, d):
    s = B.fuel_scenarios(fuel_base(spark, d), scenario_range=SCENARIO_RANGE)
    return s.select("route", "fuel_price", F.col("fuel_price").alias(FUEL),
                    (F.col("fuel_price") * LITRE_FACTOR).alias("fuel_price_inr_per_liter"))


IMPACT_SQL = with_ctes("""
SELECT route, base_fuel_price, fuel_price, round(predicted_price, 4) AS predicted_price,
       round(fuel_change_pct, 6) AS fuel_change_pct, round(price_impact_pct, 6) AS price_impact_pct,
       round(elasticity, 6) AS elasticity, round(baseline_price, 4) AS baseline_price FROM imp""", "enriched",
                       extra=FUEL_CTES)


@query("fuel_impact", IMPACT_SQL)
def fuel_impact(spark, d):
    return _rounded_impact(fuel_impact_table(spark, d))


@query("point_elasticity", with_ctes("SELECT route, fuel_price, round(elasticity, 6) AS elasticity FROM imp",
                                     "enriched", extra=FUEL_CTES))
def point_elasticity(spark, d):
    return fuel_impact_table(spark, d).select("route", "fuel_price", F.round("elasticity", 6).alias("elasticity"))


@query("baseline_scenario", with_ctes("""
SELECT route, arg_min(fuel_price, (abs(fuel_price - base_fuel_price), fuel_price)) AS baseline_fuel_price,
       round(min(baseline_price), 4) AS baseline_price FROM imp GROUP BY route""", "enriched", extra=FUEL_CTES))
def baseline_scenario(spark, d):
    t = fuel_impact_table(spark, d)
    return t.groupBy("route").agg(
        F.min_by("fuel_price", F.struct(F.abs(F.col("fuel_price") - F.col("base_fuel_price")), F.col("fuel_price")))
        .alias("baseline_fuel_price"), F.round(F.min("baseline_price"), 4).alias("baseline_price"))


@query("sort_scenarios", with_ctes("SELECT route, fuel_price, round(predicted_price, 4) AS predicted_price FROM imp "
                                   "ORDER BY route, fuel_price", "enriched", extra=FUEL_CTES))
def sort_scenarios(spark, d):
    t = fuel_impact_table(spark, d).select("route", "fuel_price", F.round("predicted_price", 4).alias("predicted_price"))
    return t.orderBy("route", "fuel_price")


SUMMARY_SQL = with_ctes("""
SELECT route, round(min(predicted_price), 4) AS price_min, round(max(predicted_price), 4) AS price_max,
       round(max(fuel_change_pct), 6) AS max_fuel_impact, round(max(price_impact_pct), 6) AS max_price_impact,
       round(avg(elasticity), 6) AS average_elasticity,
       CASE WHEN max(abs(price_impact_pct)) < 5 THEN 'Low' WHEN max(abs(price_impact_pct)) < 15 THEN 'Medium'
            ELSE 'High' END AS sensitivity_level,
       CASE WHEN avg(elasticity) < 0.2 THEN 'Very Low' WHEN avg(elasticity) < 0.5 THEN 'Low'
            WHEN avg(elasticity) < 1.0 THEN 'Moderate' WHEN avg(elasticity) < 2.0 THEN 'High' ELSE 'Very High' END
         AS elasticity_level
FROM imp GROUP BY route""", "enriched", extra=FUEL_CTES)


@query("scenario_summary", SUMMARY_SQL)
def scenario_summary(spark, d):
    s = B.scenario_summary(fuel_impact_table(spark, d))
    return s.select("route", F.round("price_min", 4).alias("price_min"), F.round("price_max", 4).alias("price_max"),
                    F.round("max_fuel_impact", 6).alias("max_fuel_impact"),
                    F.round("max_price_impact", 6).alias("max_price_impact"),
                    F.round("average_elasticity", 6).alias("average_elasticity"), "sensitivity_level",
                    "elasticity_level")


@query("trend_line", with_ctes("""
SELECT route, round(regr_slope(predicted_price, fuel_price), 6) AS slope,
       round(regr_intercept(predicted_price, fuel_price), 4) AS intercept,
       round(regr_r2(predicted_price, fuel_price), 6) AS r2, min(fuel_price) AS x_min, max(fuel_price) AS x_max,
       round(regr_slope(predicted_price, fuel_price) * min(fuel_price) + regr_intercept(predicted_price, fuel_price), 4)
         AS y_at_min,
       round(regr_slope(predicted_price, fuel_price) * max(fuel_price) + regr_intercept(predicted_price, fuel_price), 4)
         AS y_at_max
FROM imp GROUP BY route""", "enriched", extra=FUEL_CTES))
def trend_line(spark, d):
    return A.trend_line(fuel_impact_table(spark, d), "fuel_price", "predicted_price", by=["route"])


@query("sensitivity_level", with_ctes("SELECT route, sensitivity_level FROM (" + SUMMARY_SQL[SUMMARY_SQL.index("SELECT route, round(min"):] + ")",
                                      "enriched", extra=FUEL_CTES))
def sensitivity_level(spark, d):
    return B.scenario_summary(fuel_impact_table(spark, d)).select("route", "sensitivity_level")


@query("elasticity_level", with_ctes("SELECT route, elasticity_level FROM (" + SUMMARY_SQL[SUMMARY_SQL.index("SELECT route, round(min"):] + ")",
                                     "enriched", extra=FUEL_CTES))
def elasticity_level(spark, d):
    return B.scenario_summary(fuel_impact_table(spark, d)).select("route", "elasticity_level")
