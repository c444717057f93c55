"""Booking, fuel and quote queries over trained models.

A fit has no SQL twin, so each query returns the keys and the numbers that SQL can give, and says of the
model's numbers whether they equal those of a second, relational way: the saved coefficient table joined with
the raw feature values of each request, or the long-form predictions of the models one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.constants import LITRE_FACTOR, SCENARIO_DEFAULTS
from farelens.functions.dates import season_name
from farelens.operators import booking as B
from farelens.operators.encode import split_rows
from farelens.operators import models as ML
from farelens.operators import scoring as SC
from farelens.operators.stats import materialize
from farelens.plans import base
from farelens.plans.oracle import with_ctes
from farelens.plans.q_booking import DEPARTURES, REQ_CTES, REQ_NAMES, SCENARIO_RANGE, priced_scenarios, requests
from farelens.plans.q_models import MODELS, _TEST_ROWS, once, trained, training_frames, training_set
from farelens.plans.registry import query
from farelens.session import scratch_path

# labels of a request that the form and the optimiser do not ask for
LABEL_DEFAULTS = {"class": "Economy", "stop": "zero", "dep_time": "Morning", "arr_time": "Evening", "airline_type": "Other",
                  "route_type": "Domestic"}
DEFAULTS = {**SCENARIO_DEFAULTS, **LABEL_DEFAULTS}
NEAR = 1e-6


def _same(a, b):
    """Equal but for rounding in the order of a sum."""
    return F.abs(a - b) <= F.lit(NEAR) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def booking_rows(spark, d) -> DataFrame:
    """Feature rows of every booking scenario, with the pattern price as ``pattern_price``."""
    scen = priced_scenarios(spark, d).withColumnRenamed("predicted_price", "pattern_price")
    rows = B.scenario_features(scen, base.calendar(spark), base.series(spark, d)).drop("season_encoded")
    return rows.withColumn("season", season_name(F.col("month")))


@query("optimal_booking_model", with_ctes("""
SELECT route, departure_date, count(*) AS n_scenarios, max(days_ahead) AS longest, TRUE AS by_coefficients, TRUE AS lowest, TRUE AS ordered
FROM scen GROUP BY route, departure_date""", *REQ_NAMES, extra={k: REQ_CTES[k] for k in ("req", "scen")}))
def optimal_booking_model(spark, d):
    """Scenarios scored by the ridge model, the pattern price where it gives none; the least per request."""
    state, model = training_set(spark, d)["state"], trained(spark, d, "linear_regression")
    rows = materialize(booking_rows(spark, d), "booking-rows")
    scored = SC.model_scorer(model, state, DEFAULTS, fallback=F.col("pattern_price"))(rows)
    best = B.optimal_booking(scored)
    keys = ["route", "departure_date", "days_ahead"]
    hand = SC.by_coefficients(rows, SC.coefficient_table(model, state), state, model.intercept, keys, DEFAULTS).join(
        rows.select(*keys, "pattern_price"), keys).withColumn("price", F.when(F.col("by_hand") >= 0, F.col("by_hand")).otherwise(F.col("pattern_price")))
    again = hand.groupBy("route", "departure_date").agg(F.min("price").alias("least"), F.map_from_entries(
        F.collect_list(F.struct("days_ahead", "price"))).alias("prices"))
    one = best.join(again, ["route", "departure_date"])
    all_same = F.forall("all_scenarios", lambda s: _same(s["predicted_price"], F.element_at("prices", s["days_ahead"])))
    days = F.transform("all_scenarios", lambda s: s["days_ahead"])
    return one.select("route", "departure_date", "n_scenarios", F.array_max(days).alias("longest"), all_same.alias("by_coefficients"),
                      _same(F.col("predicted_lowest_price"), F.col("least")).alias("lowest"), (days == F.array_sort(days)).alias("ordered"))


# ---------------------------------------------------------------- B5, B6
def form_rows(spark, d) -> DataFrame:
    """The form's feature row of every route, travelling on the first request date."""
    req = requests(spark, d).where(F.col("departure_date") == F.lit(DEPARTURES[0]).cast("date"))
    req = req.withColumnRenamed("departure_date", "travel_date").withColumns({"dep_time": F.lit("Morning"), "duration": F.lit(2.5)})
    rows = B.form_features(req, base.series(spark, d))
    return rows.withColumn("season", season_name(F.col("month"))).where("fuel_price_usd_per_barrel is not null")


def _what_if(spark, d) -> DataFrame:
    """The what-if table, with base price and scenario price computed from the coefficient table."""
    state, model = training_set(spark, d)["state"], trained(spark, d, "linear_regression")
    rows = materialize(form_rows(spark, d), "form-rows")
    found = SC.fuel_what_if(rows, SC.model_scorer(model, state, DEFAULTS), ["route"], scenario_range=SCENARIO_RANGE)
    # the price is linear in fuel: slope per dollar from the two fuel columns of the coefficient table
    table = {r["feature"]: r for r in SC.coefficient_table(model, state).collect()}
    usd, litre = table["fuel_price_usd_per_barrel"], table["fuel_price_inr_per_liter"]
    slope = usd["coefficient"] / usd["scale"] + LITRE_FACTOR * litre["coefficient"] / litre["scale"]
    hand = SC.by_coefficients(rows, SC.coefficient_table(model, state), state, model.intercept, ["route"], DEFAULTS)
    out = found.join(hand, "route")
    return out.withColumns({"hand_price": F.col("by_hand") + F.lit(slope) * (F.col("fuel_price") - F.col("base_fuel_price")),
                            "change": (F.col("fuel_price") - F.col("base_fuel_price")) / F.col("base_fuel_price")})


_FORM_FUEL = {
    "req": REQ_CTES["req"],
    "nf": f"""SELECT r.route, b.fuel AS base_fuel_price FROM (SELECT DISTINCT route FROM req) r,
              (SELECT arg_min(fu.fuel_price_usd_per_barrel, (abs(date_diff('day', DATE '{DEPARTURES[0]}', fu.date)), fu.date)) AS fuel FROM fuel fu) b""",
    "fs": f"""SELECT route, base_fuel_price,
                round(base_fuel_price * (1.0 + (CAST({-SCENARIO_RANGE} AS DOUBLE) + CAST(0.1 AS DOUBLE) * i)), 2) AS fuel_price
              FROM nf, range(0, {int(2 * SCENARIO_RANGE / 0.1 + 1e-9) + 1}) t(i)""",
}


@query("fuel_impact_model", with_ctes("""
SELECT route, base_fuel_price, fuel_price, round((fuel_price - base_fuel_price) / base_fuel_price * 100, 6) AS fuel_change_pct,
       TRUE AS by_coefficients, TRUE AS impact FROM fs""", "fares", "fuel", extra=_FORM_FUEL))
def fuel_impact_model(spark, d):
    """B5 under the ridge model: price and impact of every fuel scenario of every route."""
    w = _what_if(spark, d)
    p, b = F.col("predicted_price"), F.col("baseline_price")
    return w.select("route", "base_fuel_price", "fuel_price", F.round("fuel_change_pct", 6).alias("fuel_change_pct"),
                    _same(p, F.col("hand_price")).alias("by_coefficients"),
                    (F.abs(F.col("price_impact_pct") - (F.col("hand_price") - b) / b * 100) < 1e-4).alias("impact"))


@query("point_elasticity_model", with_ctes("""
SELECT route, fuel_price, fuel_price <> base_fuel_price AS moved, TRUE AS by_coefficients FROM fs""", "fares", "fuel", extra=_FORM_FUEL))
def point_elasticity_model(spark, d):
    """B6 under the ridge model: the change of price against that of fuel, from base row and scenario scored together."""
    w = _what_if(spark, d)
    hand = F.when(F.col("change") != 0, (F.col("hand_price") - F.col("by_hand")) / F.col("by_hand") / F.col("change")).otherwise(F.lit(0.0))
    return w.select("route", "fuel_price", (F.col("fuel_price") != F.col("base_fuel_price")).alias("moved"),
                    (F.abs(F.col("elasticity") - hand) <= 1e-5 * F.greatest(F.abs(hand), F.lit(1.0))).alias("by_coefficients"))


# ---------------------------------------------------------------- M13, B7
# The quote queries show how several saved models are scored and combined. They train tree models of their own,
# smaller than the defaults, which ``random_forest`` and ``boosted_trees`` fit in full.
QUOTE_SIZES = {"linear_regression": {}, "random_forest": {"num_trees": 20, "max_depth": 8}, "boosted_trees": {"max_iter": 20, "max_depth": 4}}


def _three(spark, d) -> dict:
    """The three models with their validation metrics, trained at the same time, saved, and loaded again."""
    def build():
        train, val, _, _ = training_frames(spark, d)
        models, metrics, errors = ML.train_all(train, val, params=QUOTE_SIZES)
        if errors:
            raise RuntimeError(f"models failed: {errors}")
        metrics = materialize(metrics, "quote-metrics")
        path = scratch_path(spark, "quote-models")
        for name, model in models.items():
            ML.save_model(model, f"{path}/{name}", metrics.where(F.col("model") == name), QUOTE_SIZES[name])
        return path
    path = once(spark, ("quotes", d), build)
    metrics = None
    for name in MODELS:
        own, _ = ML.load_training(f"{path}/{name}")
        metrics = own if metrics is None else metrics.unionByName(own)
    return {"models": {name: ML.load_model(f"{path}/{name}") for name in MODELS}, "metrics": metrics}


@query("ensemble_model", with_ctes(f"SELECT fare_key, TRUE AS average, TRUE AS weighted, TRUE AS median FROM ({_TEST_ROWS})", "quotes"))
def ensemble_model(spark, d):
    """M13 over the trained models: test rows scored in one scan, against the models' long-form predictions."""
    _, _, test, _ = training_frames(spark, d)
    saved, t = _three(spark, d), training_set(spark, d)
    models, metrics = saved["models"], saved["metrics"]
    # the split is a function of the key, so the test rows are found without a join
    rows = split_rows(t["features"]).where("split = 'test'").drop("split")
    wide = SC.ensemble_predictions(rows, models, t["state"], metrics)
    one_by_one = ML.predict(models[MODELS[0]], test, MODELS[0])
    for m in MODELS[1:]:
        one_by_one = one_by_one.unionByName(ML.predict(models[m], test, m))
    weight = metrics.where("split = 'val'").select("model", (F.lit(1.0) / (F.col("rmse") + 1e-8)).alias("w"))
    again = ML.wide_predictions(one_by_one, MODELS).join(one_by_one.join(F.broadcast(weight), "model").groupBy("fare_key").agg(
        (F.sum(F.col("prediction") * F.col("w")) / F.sum("w")).alias("weighted"), F.avg("prediction").alias("mean"),
        F.median("prediction").alias("middle")), "fare_key")
    out = wide.select("fare_key", "ensemble_average", "ensemble_weighted", "ensemble_median").join(again, "fare_key")
    return out.select("fare_key", _same(F.col("ensemble_average"), F.col("mean")).alias("average"),
                      _same(F.col("ensemble_weighted"), F.col("weighted")).alias("weighted"),
                      (_same(F.col("ensemble_median"), F.col("middle"))
                       & _same(F.col("middle"), F.array_sort(F.array(*MODELS))[1])).alias("median"))


@query("multi_model_quote_model", with_ctes("""
SELECT route, departure_date AS travel_date, TRUE AS models_differ, TRUE AS inside, TRUE AS spread, TRUE AS confident, TRUE AS advised
FROM req WHERE departure_date = (SELECT min(departure_date) FROM req)""", "fares", extra={"req": REQ_CTES["req"]}))
def multi_model_quote_model(spark, d):
    """B7 over the trained models: every form request quoted by all of them at once."""
    models, state = _three(spark, d)["models"], training_set(spark, d)["state"]
    cols = [f"pred_{m}" for m in MODELS]
    q = B.multi_model_quote(SC.score_models(form_rows(spark, d), models, state, DEFAULTS), cols)
    prices = F.array(*cols)
    mean, low, high = F.col("ensemble_mean"), F.col("ensemble_min"), F.col("ensemble_max")
    deviation = F.sqrt(F.aggregate(prices, F.lit(0.0), lambda a, p: a + (p - mean) * (p - mean)) / 3.0)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - deviation / mean))
    level = F.element_at(F.split("advice", " "), 1)
    return q.select("route", "travel_date", (F.size(F.array_distinct(prices)) > 1).alias("models_differ"),
                    ((low <= mean) & (mean <= high) & (F.array_min(prices) == low) & (F.array_max(prices) == high)).alias("inside"),
                    _same(F.col("uncertainty"), (high - low) / 2).alias("spread"), (F.abs(conf - F.col("confidence")) < 1e-9).alias("confident"),
                    (level == F.when(F.col("confidence") > 0.8, "High").when(F.col("confidence") > 0.6, "Moderate").otherwise("Low")).alias("advised"))
