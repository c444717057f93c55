"""Booking-date optimiser and fuel what-if scoring.

Scenarios are rows, not loops: every (route, departure) request is expanded
with ``explode(sequence(...))`` into its booking dates, every base row into
its fuel scenarios, and all of them are scored in one job by a scoring
function ``DataFrame -> DataFrame`` (a fitted ``pyspark.ml`` model's
``transform``, or a fitted per-route trend line). Per-request reductions
(best day, baseline scenario, trend) are grouped aggregates over the
scenarios of one request, which are at most a dozen rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from farelens.constants import (BOOKING_DAYS_START, BOOKING_DAYS_STEP, BOOKING_DAYS_STOP, LITRE_FACTOR,
                                MAJOR_CITIES, MAJOR_CITIES_FORM, PATTERN_BASE_PRICE, SCENARIO_DEFAULTS,
                                TIME_SLOTS)
from farelens.functions.dates import date_parts, season_code
from farelens.functions.lookups import lookup
from farelens.functions.money import round_binary
from farelens.functions.scores import (booking_advice, confidence_level, confidence_score, elasticity_level,
                                       price_advice, sensitivity_level, spread_confidence)
from farelens.operators.enrich import holiday_exact, holiday_window, nearest_date

Scorer = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------- J10
def booking_scenarios(requests: DataFrame, as_of: str, departure: str = "departure_date",
                      start: int = BOOKING_DAYS_START, stop: int = BOOKING_DAYS_STOP,
                      step: int = BOOKING_DAYS_STEP) -> DataFrame:
    """One row per request and booking lead time (1, 8, ... < 90 days); past dates dropped."""
    days = F.sequence(F.lit(start), F.lit(stop), F.lit(step))
    out = requests.withColumn("days_ahead", F.explode(days))
    out = out.withColumn("booking_date", F.date_sub(F.col(departure), F.col("days_ahead")))
    return out.where(F.col("booking_date") >= F.to_date(F.lit(as_of)))


# ---------------------------------------------------------------- B1, B2
def scenario_features(scen: DataFrame, calendar: DataFrame, series: DataFrame | None = None,
                      fuel_price: float | None = None, date_col: str = "booking_date",
                      major_cities=None) -> DataFrame:
    """B1: the model's feature row for each scenario (dates, holidays, fuel, cities, fixed defaults)."""
    cities = list(major_cities or MAJOR_CITIES)
    d = F.col(date_col)
    parts = date_parts(d)
    out = scen.withColumns(parts).withColumns({
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "is_month_end": (F.col("day") >= 25).cast("int"),
        "days_left": F.col("days_ahead"),
        "season_encoded": season_code(F.col("month")),
    })
    out = holiday_exact(out, calendar, date_col).drop("holiday_name")
    out = holiday_window(out, calendar, date_col).drop("days_to_holiday", "season_holiday_name", "holiday_impact",
                                                       "season_type")
    out = out.withColumns({"is_holiday": F.col("is_holiday").cast("int"),
                           "is_holiday_season": F.col("is_holiday_season").cast("int")})
    if fuel_price is not None:
        out = out.withColumn("fuel_price_usd_per_barrel", F.lit(float(fuel_price)))
    else:
        out = nearest_date(out, series, date_col).drop("nearest_date")
    f_major = F.coalesce(F.col("from").isin(cities), F.lit(False))
    t_major = F.coalesce(F.col("to").isin(cities), F.lit(True))
    out = out.withColumns({
        "fuel_price_inr_per_liter": F.col("fuel_price_usd_per_barrel") * F.lit(LITRE_FACTOR),
        "from_major_city": f_major.cast("int"),
        "to_major_city": t_major.cast("int"),
        "major_to_major": (f_major & F.coalesce(F.col("to").isin(cities), F.lit(False))).cast("int"),
    })
    return out.withColumns({k: F.lit(v) for k, v in SCENARIO_DEFAULTS.items()})


def form_features(requests: DataFrame, series: DataFrame, date_col: str = "travel_date",
                  dep_time: str = "dep_time", duration: str = "duration", cities=None) -> DataFrame:
    """B2: the form's feature row for ad-hoc requests (fuel from the nearest series day)."""
    cities = list(cities or MAJOR_CITIES_FORM)
    d = F.col(date_col)
    out = nearest_date(requests, series, date_col).drop("nearest_date")
    f_major = F.coalesce(F.col("from").isin(cities), F.lit(False))
    t_major = F.coalesce(F.col("to").isin(cities), F.lit(False))
    form_slots = {k: v for k, v in TIME_SLOTS.items() if k != "Late Night"}
    return out.withColumns({
        "year": F.year(d), "month": F.month(d), "day_of_week": F.weekday(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "fuel_price_inr_per_liter": F.col("fuel_price_usd_per_barrel") * F.lit(LITRE_FACTOR),
        "is_holiday": F.lit(0), "holiday_impact_score": F.lit(0), "is_holiday_season": F.lit(0),
        "from_major_city": f_major.cast("int"), "to_major_city": t_major.cast("int"),
        "major_to_major": (f_major & t_major).cast("int"),
        "route_popularity": F.lit(1000),
        "dep_time_slot": lookup(F.col(dep_time), form_slots, 2),
        "arr_time_slot": F.lit(4),
        "is_peak_departure": F.coalesce(F.col(dep_time).isin("Morning", "Evening"), F.lit(False)).cast("int"),
        "flight_hours": F.col(duration).cast("double"),
        "total_flight_minutes": F.col(duration).cast("double") * 60,
        "airline_market_share": F.lit(5000),
    })


# ---------------------------------------------------------------- J8
def month_profiles(monthly: DataFrame) -> DataFrame:
    """Per route: ``month -> mean price`` map (at most 12 entries per route)."""
    return monthly.groupBy("route").agg(
        F.map_from_entries(F.collect_list(F.struct("month", "mean_price"))).alias("month_means"))


def window_factor(days: Column) -> Column:
    return (F.when(days <= 7, F.lit(1.2)).when(days <= 14, F.lit(1.1))
            .when((days >= 30) & (days <= 60), F.lit(0.9)).otherwise(F.lit(None)))


def pattern_price(scen: DataFrame, monthly: DataFrame, base_price: float = PATTERN_BASE_PRICE,
                  date_col: str = "booking_date") -> DataFrame:
    """Price from the route's monthly means and the booking window; unknown route -> base price."""
    prof = month_profiles(monthly).withColumnRenamed("route", "_proute")
    out = scen.join(prof, F.col("route") == F.col("_proute"), "left")
    known = F.col("_proute").isNotNull()
    base = F.lit(float(base_price))
    m = F.element_at(F.col("month_means"), F.month(F.col(date_col)))
    seasonal = F.when(m.isNotNull(), base * (m / base)).otherwise(base)
    fac = window_factor(F.col("days_ahead"))
    adjusted = F.when(fac.isNotNull(), seasonal * fac).otherwise(seasonal)
    return out.withColumn("predicted_price", F.when(known, adjusted).otherwise(base)).drop("_proute", "month_means")


# ---------------------------------------------------------------- B3, K4, W5
def optimal_booking(priced: DataFrame, keys=("route", "departure_date")) -> DataFrame:
    """Cheapest booking date per request (ties -> fewest days ahead), with trend and advice."""
    keys = list(keys)
    scored = priced.withColumn("confidence_score", confidence_score(F.col("days_ahead")))
    s = F.struct("days_ahead", "booking_date", "predicted_price", "confidence_score")
    g = scored.groupBy(*keys).agg(
        F.min(F.struct("predicted_price", "days_ahead", "booking_date", "confidence_score")).alias("best"),
        F.min_by("predicted_price", "days_ahead").alias("_first"),
        F.max_by("predicted_price", "days_ahead").alias("_last"),
        F.count(F.lit(1)).alias("n_scenarios"),
        F.array_sort(F.collect_list(s)).alias("all_scenarios"))
    trend = (F.when(F.col("n_scenarios") <= 1, "stable")
             .when(F.col("_last") > F.col("_first"), "increasing").otherwise("decreasing"))
    out = g.select(*keys,
                   F.col("best.booking_date").alias("optimal_booking_date"),
                   F.col("best.days_ahead").alias("optimal_days_ahead"),
                   F.col("best.predicted_price").alias("predicted_lowest_price"),
                   F.col("best.confidence_score").alias("confidence_score"),
                   "n_scenarios", trend.alias("trend"), "all_scenarios")
    return out.withColumn("recommendation", booking_advice(F.col("optimal_days_ahead"), F.col("predicted_lowest_price"),
                                                           F.col("confidence_score"), F.col("trend")))


# ---------------------------------------------------------------- B4
def fuel_scenarios(base: DataFrame, base_col: str = "base_fuel_price", scenario_range: float = 0.3) -> DataFrame:
    """``base * (1 + pct)`` for pct = -r, -r+0.1, ... never above +r, rounded to cents."""
    n = int((2 * scenario_range) / 0.1 + 1e-9)
    pct = F.lit(-float(scenario_range)) + F.lit(0.1) * F.col("_i")
    return (base.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n))))
            .withColumn("fuel_price", round_binary(F.col(base_col) * (F.lit(1.0) + pct), 2)).drop("_i"))


# ---------------------------------------------------------------- B5, B6, K5, A18
def fuel_impact(scenarios: DataFrame, score: Scorer, keys=("route",), base_col: str = "base_fuel_price") -> DataFrame:
    """Predicted price per fuel scenario, change vs base fuel, impact vs baseline, point elasticity.

    ``score`` adds ``predicted_price`` from ``fuel_price_usd_per_barrel``. The
    price at the base fuel is scored in the same pass (one extra row per key).
    """
    keys = list(keys)
    fuel, litre = "fuel_price_usd_per_barrel", "fuel_price_inr_per_liter"
    rows = scenarios.withColumn("_is_base", F.lit(False))
    base_rows = scenarios.dropDuplicates(keys).withColumn("fuel_price", F.col(base_col)).withColumn("_is_base", F.lit(True))
    both = rows.unionByName(base_rows).withColumns({fuel: F.col("fuel_price"), litre: F.col("fuel_price") * LITRE_FACTOR})
    scored = score(both)
    base_price = scored.where("_is_base").select(*keys, F.col("predicted_price").alias("_p0"))
    sc = scored.where(~F.col("_is_base")).join(base_price, keys)
    f0, f1, p1 = F.col(base_col), F.col("fuel_price"), F.col("predicted_price")
    fchg = (f1 - f0) / f0
    elasticity = F.when(fchg != 0, ((p1 - F.col("_p0")) / F.col("_p0")) / fchg).otherwise(F.lit(0.0))
    sc = sc.withColumns({"fuel_change_pct": fchg * 100, "elasticity": elasticity})
    baseline = sc.groupBy(*keys).agg(F.min_by(p1, F.struct(F.abs(f1 - f0), f1)).alias("baseline_price"))
    out = sc.join(baseline, keys)
    out = out.withColumn("price_impact_pct", (p1 - F.col("baseline_price")) / F.col("baseline_price") * 100)
    return out.select(*keys, base_col, "fuel_price", "predicted_price", "fuel_change_pct", "price_impact_pct",
                      "elasticity", "baseline_price")


def scenario_summary(impact: DataFrame, keys=("route",)) -> DataFrame:
    """Price range, largest fuel change and impact, mean elasticity, levels."""
    g = impact.groupBy(*keys).agg(
        F.min("predicted_price").alias("price_min"), F.max("predicted_price").alias("price_max"),
        F.max("fuel_change_pct").alias("max_fuel_impact"), F.max("price_impact_pct").alias("max_price_impact"),
        F.avg("elasticity").alias("average_elasticity"), F.max(F.abs("price_impact_pct")).alias("_abs"))
    return g.withColumns({"sensitivity_level": sensitivity_level(F.col("_abs")),
                          "elasticity_level": elasticity_level(F.col("average_elasticity"))}).drop("_abs")


# ---------------------------------------------------------------- per-route trend scorer
def route_trend_model(df: DataFrame, x: str = "fuel_price_usd_per_barrel", y: str = "price",
                      keys=("route",)) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per route (one row per route)."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def trend_scorer(model: DataFrame, keys=("route",), x: str = "fuel_price_usd_per_barrel") -> Scorer:
    """A scorer that applies the per-route line (joined on the route key)."""
    keys = list(keys)

    def score(df: DataFrame) -> DataFrame:
        m = model.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "slope", "intercept")
        cond = [F.col(k) == F.col(f"_m_{k}") for k in keys]
        out = df.join(m, cond, "left")
        return out.withColumn("predicted_price", F.col("intercept") + F.col("slope") * F.col(x)).drop(
            *[f"_m_{k}" for k in keys], "slope", "intercept")
    return score


# ---------------------------------------------------------------- B7, F16, F17
def multi_model_quote(df: DataFrame, pred_cols: list[str]) -> DataFrame:
    """Per request, every model's prediction, the ensemble summary, spread confidence and advice."""
    cols = [F.col(c) for c in pred_cols]
    k = float(len(cols))
    mean = sum(cols[1:], cols[0]) / F.lit(k)
    var = sum([(c - mean) * (c - mean) for c in cols[1:]], (cols[0] - mean) * (cols[0] - mean)) / F.lit(k)
    out = df.withColumns({"ensemble_mean": mean, "ensemble_min": F.least(*cols), "ensemble_max": F.greatest(*cols)})
    out = out.withColumn("uncertainty", (F.col("ensemble_max") - F.col("ensemble_min")) / F.lit(2.0))
    conf = spread_confidence(F.sqrt(var), mean, F.lit(len(cols)))
    out = out.withColumn("confidence", conf)
    return out.withColumns({"confidence_level": confidence_level(F.col("confidence")),
                            "advice": price_advice(F.col("ensemble_mean"), F.col("confidence"))})
