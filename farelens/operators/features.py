"""Row features of fares (F1-F13) and group counts joined back.

Group counts use aggregate + join instead of a window: the aggregate combines
map-side (a route holding a third of all rows costs one row per map task),
and the count table is joined back with a size-checked broadcast, so no task
ever receives all rows of one route or carrier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.constants import (BOOKING_BANDS, BUDGET_AIRLINES, BUDGET_AIRLINES_NOTEBOOK,
                                DURATION_HOUR_BANDS, DURATION_MINUTE_BANDS, MAJOR_CITIES, PEAK_TIMES,
                                PREMIUM_AIRLINES, SLOT_HOURS, TIME_SLOT_DEFAULT, TIME_SLOTS)
from farelens.functions.bands import right_closed_band
from farelens.functions.dates import date_parts, season_name
from farelens.functions.lookups import lookup
from farelens.operators.stats import bounded_broadcast


def temporal_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar parts, season, weekend and month-end flags."""
    if date_col not in df.columns:
        return df
    d = F.to_date(F.col(date_col))
    parts = date_parts(d)
    out = df.withColumns(parts)
    return out.withColumns({
        "season": season_name(F.col("month")),
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "is_month_end": (F.col("day") >= 25).cast("int"),
    })


def group_count(df: DataFrame, keys: list[str], name: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Number of rows sharing ``keys``, attached to every row.

    Null keys count as their own group (as a group-size lookup would), so the
    join is null-safe.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cnt")
    small = bounded_broadcast(counts, max_bytes)
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = df.join(small, cond, "left")
    return out.select(*[F.col(c) for c in df.columns], F.coalesce(F.col("_cnt"), F.lit(0)).alias(name))


def route_and_carrier_counts(df: DataFrame, max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Route and carrier row counts from ONE aggregate over ``df`` (both written, size-checked).

    Returns ``(route_counts(_k0, _k1, _cnt), carrier_counts(_airline, airline_market_share))``.
    """
    items = F.array(
        F.struct(F.lit("route").alias("kind"), F.col("from").alias("k0"), F.col("to").alias("k1")),
        F.struct(F.lit("airline").alias("kind"), F.col("airline").alias("k0"), F.lit(None).cast("string").alias("k1")))
    counts = (df.select(F.explode(items).alias("g")).select("g.*")
              .groupBy("kind", "k0", "k1").agg(F.count(F.lit(1)).alias("_cnt")))
    saved = bounded_broadcast(counts, max_bytes)
    routes = saved.where(F.col("kind") == "route").select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), "_cnt")
    carriers = saved.where((F.col("kind") == "airline") & F.col("k0").isNotNull()).select(
        F.col("k0").alias("_airline"), F.col("_cnt").alias("airline_market_share"))
    return routes, carriers


def route_features(df: DataFrame, major_cities=None, counts: DataFrame | None = None) -> DataFrame:
    """F4 + J5: route popularity, major-city flags, route type."""
    if "from" not in df.columns or "to" not in df.columns:
        return df
    cities = list(major_cities or MAJOR_CITIES)
    if counts is None:
        out = group_count(df, ["from", "to"], "route_popularity")
    else:
        j = df.join(counts, F.col("from").eqNullSafe(F.col("_k0")) & F.col("to").eqNullSafe(F.col("_k1")), "left")
        out = j.select(*[F.col(c) for c in df.columns], F.coalesce(F.col("_cnt"), F.lit(0)).alias("route_popularity"))
    f = F.col("from").isin(cities).cast("int")
    t = F.col("to").isin(cities).cast("int")
    return out.withColumns({
        "from_major_city": F.coalesce(f, F.lit(0)),
        "to_major_city": F.coalesce(t, F.lit(0)),
    }).withColumns({
        "major_to_major": (F.col("from_major_city") * F.col("to_major_city")).cast("int"),
        "route_type": F.lit("Domestic"),
    })


def time_features(df: DataFrame, slots: dict | None = None) -> DataFrame:
    """slot numbers (default 3) and the peak-departure flag."""
    slots = slots or TIME_SLOTS
    cols = {}
    if "dep_time" in df.columns:
        cols["dep_time_slot"] = lookup(F.col("dep_time"), slots, TIME_SLOT_DEFAULT)
    if "arr_time" in df.columns:
        cols["arr_time_slot"] = lookup(F.col("arr_time"), slots, TIME_SLOT_DEFAULT)
    if "dep_time" in df.columns:
        cols["is_peak_departure"] = F.coalesce(F.col("dep_time").isin(PEAK_TIMES), F.lit(False)).cast("int")
    return df.withColumns(cols)


def duration_features(df: DataFrame) -> DataFrame:
    """hours/minutes from ``'Xh YYm'`` text (defaults 2 and 0), total minutes, band."""
    if "time_taken" in df.columns:
        pat = r"(\d+)h\s*(\d+)m"
        h = F.nullif(F.regexp_extract("time_taken", pat, 1), F.lit("")).try_cast("double")
        m = F.nullif(F.regexp_extract("time_taken", pat, 2), F.lit("")).try_cast("double")
        out = df.withColumns({"flight_hours": F.coalesce(h, F.lit(2.0)),
                              "flight_minutes": F.coalesce(m, F.lit(0.0))})
        out = out.withColumn("total_flight_minutes", F.col("flight_hours") * 60 + F.col("flight_minutes"))
    elif "duration" in df.columns:
        out = df.withColumn("flight_hours", F.coalesce(F.col("duration").cast("double"), F.lit(2.0)))
        out = out.withColumn("total_flight_minutes", F.col("flight_hours") * 60)
    else:
        return df
    return out.withColumn("duration_category", right_closed_band(F.col("total_flight_minutes"), DURATION_MINUTE_BANDS))


def airline_features(df: DataFrame, budget=None, premium=None, counts: DataFrame | None = None, share: bool = False) -> DataFrame:
    """F7 + J6: carrier type and carrier row count (named market share, a count).

    ``share`` adds ``airline_share``, the count over the rows of all carriers (null without a carrier).
    """
    if "airline" not in df.columns:
        return df
    budget, premium = list(budget or BUDGET_AIRLINES), list(premium or PREMIUM_AIRLINES)
    a = F.col("airline")
    out = df.withColumn("airline_type", F.when(a.isin(premium), "Premium").when(a.isin(budget), "Budget")
                        .otherwise("Other"))
    if counts is None:
        counts = df.where(a.isNotNull()).groupBy("airline").agg(F.count(F.lit(1)).alias("airline_market_share"))
        counts = bounded_broadcast(counts.select(F.col("airline").alias("_airline"), "airline_market_share"))
    small = counts
    out = out.join(small, F.col("airline") == F.col("_airline"), "left").drop("_airline")
    if not share:
        return out
    total = small.agg(F.sum("airline_market_share")).first()[0] or 0
    return out.withColumn("airline_share", F.try_divide(F.col("airline_market_share"), F.lit(total)))


def route_key(df: DataFrame, sep: str = "_", src: str = "source_city", dst: str = "destination_city",
              name: str = "route") -> DataFrame:
    """F8: route text (notebook form ``source_destination``)."""
    return df.withColumn(name, F.concat_ws(sep, F.col(src), F.col(dst)))


def hour_of_slot(df: DataFrame, dep: str = "departure_time", arr: str = "arrival_time") -> DataFrame:
    """raw slot label -> hour of day (unknown -> null)."""
    return df.withColumns({"departure_hour": lookup(F.col(dep), SLOT_HOURS),
                           "arrival_hour": lookup(F.col(arr), SLOT_HOURS)})


def fare_flags(df: DataFrame, airline: str = "airline", stops: str = "stops", cls: str = "class",
               days: str = "days_left", budget=None) -> DataFrame:
    """budget carrier, has stops, premium class, last-minute booking."""
    budget = list(budget or BUDGET_AIRLINES_NOTEBOOK)
    return df.withColumns({
        "is_budget_airline": F.coalesce(F.col(airline).isin(budget), F.lit(False)).cast("int"),
        "has_stops": F.coalesce(F.col(stops) != "zero", F.lit(True)).cast("int"),
        "is_premium_class": F.coalesce(F.col(cls) == "Business", F.lit(False)).cast("int"),
        "is_last_minute": F.coalesce(F.col(days) <= 7, F.lit(False)).cast("int"),
    })


def booking_band(df: DataFrame, days: str = "days_left") -> DataFrame:
    """(0,7], (7,21], (21,60], (60,inf) booking bands."""
    return df.withColumn("booking_category", right_closed_band(F.col(days), BOOKING_BANDS))


def duration_band_hours(df: DataFrame, hours: str = "duration") -> DataFrame:
    """(0,2], (2,4], (4,8], (8,inf) hour bands."""
    return df.withColumn("duration_category", right_closed_band(F.col(hours), DURATION_HOUR_BANDS))


def notebook_features(df: DataFrame) -> DataFrame:
    """The notebook feature set over a clean-file shaped table."""
    return (df.transform(route_key).transform(hour_of_slot).transform(fare_flags)
            .transform(booking_band).transform(duration_band_hours))


def feature_engineering(df: DataFrame, enrich=None) -> DataFrame:
    """temporal -> route -> time -> duration -> airline -> external tables."""
    routes, carriers = route_and_carrier_counts(df) if {"from", "to", "airline"} <= set(df.columns) else (None, None)
    out = (df.transform(temporal_features).transform(route_features, counts=routes).transform(time_features)
           .transform(duration_features).transform(airline_features, counts=carriers))
    return enrich(out) if enrich is not None else out
