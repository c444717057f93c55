"""Holiday calendar, impact-score table and the synthetic daily series.

The calendar is a lookup table of a few rows per year; it is built from the
fixed definitions below for a list of years and joined to fare data through
broadcast joins (its size is bounded by ``len(years) * len(definitions)``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from farelens.functions.money import round_binary
from farelens.constants import (HOLIDAY_IMPACT_DEFAULT, HOLIDAY_IMPACT_SCORES, LITRE_FACTOR,
                                SPINE_BASE_PRICE, SPINE_SEASONAL_AMPLITUDE, SPINE_TREND_PER_DAY)

# --- fixed values: calendar definitions (month, day, name, national, type) --
# "Christmas" is deliberately not the name used in the score table, so it gets
# the default score. One extra festival falls on the same day as a national
# holiday in 1998, so the calendar holds a repeated date.
NATIONAL_DAYS = [
    (1, 1, "New Year's Day"),
    (1, 26, "Republic Day"),
    (8, 15, "Independence Day"),
    (10, 2, "Gandhi Jayanti"),
    (12, 25, "Christmas"),
]
EXTRA_FESTIVALS = [(1998, 10, 2, "Dussehra")]
DEFAULT_YEARS = tuple(range(1995, 2002))

CALENDAR_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("date_text", T.StringType(), False),
    T.StructField("holiday_name", T.StringType(), False),
    T.StructField("is_national_holiday", T.BooleanType(), False),
    T.StructField("holiday_type", T.StringType(), False),
    T.StructField("year", T.IntegerType(), False),
])


def calendar_rows(years=DEFAULT_YEARS) -> list[tuple]:
    """Raw calendar rows in file order: national days first within a year.

    Dates alternate between ``yyyy-MM-dd`` and ``yyyy-MM-dd 00:00:00`` text, the
    two forms a cached calendar file holds.
    """
    rows = []
    for y in years:
        pos = 0
        for m, d, name in NATIONAL_DAYS:
            pos += 1
            text = f"{y:04d}-{m:02d}-{d:02d}" + (" 00:00:00" if pos % 2 == 0 else "")
            rows.append(((y - years[0]) * 100 + pos, text, name, True, "National", y))
        for fy, m, d, name in EXTRA_FESTIVALS:
            if fy == y:
                pos += 1
                rows.append(((y - years[0]) * 100 + pos, f"{y:04d}-{m:02d}-{d:02d}", name, False,
                             "Regional/Festival", y))
    return rows


def raw_calendar(spark: SparkSession, years=DEFAULT_YEARS) -> DataFrame:
    return spark.createDataFrame(calendar_rows(tuple(years)), CALENDAR_SCHEMA)


def impact_scores(spark: SparkSession, scores: dict | None = None) -> DataFrame:
    scores = scores or HOLIDAY_IMPACT_SCORES
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()],
                                 "holiday_name string, score double")


def parse_calendar(raw: DataFrame) -> DataFrame:
    """S3: both date text forms -> ``date``."""
    return raw.withColumn("date", F.to_date(F.col("date_text"))).drop("date_text")


def score_holidays(cal: DataFrame, scores: DataFrame, default_score: float = HOLIDAY_IMPACT_DEFAULT) -> DataFrame:
    """``holiday_impact_score`` of each row by its name (``scores``: ``holiday_name, score``; unknown -> default).

    The score table has one row per holiday name, which bounds its broadcast.
    """
    out = cal.drop("holiday_impact_score").join(F.broadcast(scores), "holiday_name", "left")
    return out.withColumn("holiday_impact_score", F.coalesce(F.col("score"), F.lit(float(default_score)))).drop("score")


def union_calendars(*parts: DataFrame) -> DataFrame:
    """Calendars stacked by column name; ``seq`` runs on from part to part, each in its own order."""
    placed = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_part", "seq"))      # a few rows per year
    return out.withColumn("seq", order - 1).drop("_part")


def build_calendar(spark: SparkSession, years=DEFAULT_YEARS, scores: dict | None = None,
                   default_score: float = HOLIDAY_IMPACT_DEFAULT) -> DataFrame:
    """Parsed calendar of the built-in days with ``holiday_impact_score``."""
    cal = score_holidays(parse_calendar(raw_calendar(spark, years)), impact_scores(spark, scores), default_score)
    return cal.select("seq", "date", "holiday_name", "is_national_holiday", "holiday_type", "year", "holiday_impact_score")


def spine_from_range(bounds: DataFrame, *, base_price: float = SPINE_BASE_PRICE) -> DataFrame:
    """S4 over a one-row ``(start, end)`` DataFrame of dates."""
    days = bounds.select(F.col("start"), F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date"))
    i = F.datediff("date", "start")
    seasonal = F.lit(1.0) + F.lit(SPINE_SEASONAL_AMPLITUDE) * F.sin(F.lit(2 * math.pi) * F.dayofyear("date") / F.lit(365.0))
    trend = F.lit(SPINE_TREND_PER_DAY) * i
    y, m = F.year("date"), F.month("date")
    regime = (F.when((y == 2020) & (m >= 3) & (m <= 6), F.lit(0.7))
              .when((y == 2022) & (m >= 3), F.lit(1.3))
              .otherwise(F.lit(1.0)))
    price = F.lit(base_price) * seasonal * (F.lit(1.0) + trend) * regime
    return days.select(
        "date",
        round_binary(price, 2).alias("fuel_price_usd_per_barrel"),
        round_binary(price * F.lit(LITRE_FACTOR), 2).alias("fuel_price_inr_per_liter"),
    )
