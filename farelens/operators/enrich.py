"""Enrichment joins with the daily series and the holiday calendar.

Every lookup table here is keyed by calendar day, so it holds at most one row
per day of its date range (a few thousand rows for decades of data). That is
the proven size bound behind the explicit broadcasts: the large fare side is
never shuffled for enrichment.

The range join "holiday within +-7 days" is rewritten as an equi-join: each
holiday is expanded to the 15 days it covers and reduced to the first holiday
per day (in calendar order), so the join cannot fan out and no nested-loop
join is planned. The as-of join "nearest series day" is computed on the day
domain (distinct fare days plus series days) with two ordered windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from farelens.constants import HOLIDAY_WINDOW_DAYS


def join_daily_series(df: DataFrame, series: DataFrame, date_col: str = "date",
                      value_cols=("fuel_price_usd_per_barrel", "fuel_price_inr_per_liter")) -> DataFrame:
    """Left join on the day; days without a value get nulls.

    A day listed more than once keeps its smallest row, so no fare is ever repeated and the
    broadcast side holds one row per calendar day.
    """
    values = F.struct(*[F.col(c) for c in value_cols])
    right = (series.where(F.col("date").isNotNull()).groupBy(F.col("date").alias("_sd")).agg(F.min(values).alias("_v"))
             .select("_sd", *[F.col(f"_v.{c}").alias(c) for c in value_cols]))
    return (df.join(F.broadcast(right), F.to_date(F.col(date_col)) == F.col("_sd"), "left").drop("_sd"))


def first_per_date(calendar: DataFrame) -> DataFrame:
    """The first calendar row (lowest ``seq``) of every date."""
    best = calendar.groupBy("date").agg(F.min(F.struct("seq", "holiday_name", "holiday_impact_score")).alias("b"))
    return best.select("date", F.col("b.seq").alias("seq"), F.col("b.holiday_name").alias("holiday_name"),
                       F.col("b.holiday_impact_score").alias("holiday_impact_score"))


def holiday_exact(df: DataFrame, calendar: DataFrame, date_col: str = "date") -> DataFrame:
    """``is_holiday``, ``holiday_impact_score`` (0 if none) and the holiday name."""
    day = first_per_date(calendar).select(F.col("date").alias("_hd"), F.col("holiday_name"),
                                          F.col("holiday_impact_score").alias("_score"))
    out = df.join(F.broadcast(day), F.to_date(F.col(date_col)) == F.col("_hd"), "left")
    return out.select(*[out[c] for c in df.columns],
                      F.col("_hd").isNotNull().alias("is_holiday"),
                      F.coalesce(F.col("_score"), F.lit(0.0)).alias("holiday_impact_score"),
                      F.col("holiday_name"))


def holiday_window_table(calendar: DataFrame, days: int = HOLIDAY_WINDOW_DAYS, pick: str = "first") -> DataFrame:
    """Per covered day: the first holiday (calendar order) within +-``days``, or with ``pick="nearest"``
    the one fewest days away (ties: the one ahead, then calendar order)."""
    if pick not in ("first", "nearest"):
        raise ValueError("pick must be 'first' or 'nearest'")
    offsets = F.sequence(F.lit(-days), F.lit(days))
    spread = calendar.select("seq", "date", "holiday_name", "holiday_impact_score",
                             F.explode(offsets).alias("k"))
    spread = spread.select(F.date_add("date", F.col("k")).alias("day"),
                           F.struct("seq", (-F.col("k")).alias("days_to_holiday"), "holiday_name",
                                    "holiday_impact_score").alias("h"))
    order = F.struct(F.abs("h.days_to_holiday"), -F.col("h.days_to_holiday"), "h.seq")
    best = spread.groupBy("day").agg((F.min("h") if pick == "first" else F.min_by("h", order)).alias("h"))
    return best.select(F.col("day").alias("_wday"), F.col("h.days_to_holiday").alias("days_to_holiday"),
                       F.col("h.holiday_name").alias("season_holiday_name"),
                       F.col("h.holiday_impact_score").alias("holiday_impact"))


def holiday_window(df: DataFrame, calendar: DataFrame, date_col: str = "date",
                   days: int = HOLIDAY_WINDOW_DAYS, pick: str = "first") -> DataFrame:
    """Holiday within +-days: flag, signed days to it, name, impact, pre/post."""
    table = holiday_window_table(calendar, days, pick)
    out = df.join(F.broadcast(table), F.to_date(F.col(date_col)) == F.col("_wday"), "left")
    return out.select(*[out[c] for c in df.columns],
                      F.col("_wday").isNotNull().alias("is_holiday_season"),
                      F.col("days_to_holiday"), F.col("season_holiday_name"), F.col("holiday_impact"),
                      F.when(F.col("_wday").isNull(), F.lit(None))
                      .when(F.col("days_to_holiday") > 0, "pre_holiday").otherwise("post_holiday")
                      .alias("season_type"))


def nearest_value_table(days: DataFrame, series: DataFrame, value: str = "fuel_price_usd_per_barrel") -> DataFrame:
    """Nearest series day for every wanted day (ties -> the earlier series day).

    ``days`` has a ``date`` column. Both inputs are reduced to the day domain
    (one row per day) before the ordered windows, so the windows run over a
    table bounded by the number of calendar days in range.
    """
    wanted = days.select(F.col("date")).distinct().withColumn("_v", F.lit(None).cast("double")) \
        .withColumn("_sd", F.lit(None).cast("date"))
    known = series.select("date", F.col(value).alias("_v"), F.col("date").alias("_sd"))
    both = known.unionByName(wanted)
    # Series rows sort before wanted rows of the same day, so an exact hit is found.
    order = [F.col("date"), F.col("_sd").isNull()]
    w_prev = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_next = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hit = F.when(F.col("_sd").isNotNull(), F.struct(F.col("_sd").alias("d"), F.col("_v").alias("v")))
    lk = both.select(
        "date", "_sd",
        F.last(hit, ignorenulls=True).over(w_prev).alias("p"),
        F.first(hit, ignorenulls=True).over(w_next).alias("n"),
    ).where(F.col("_sd").isNull())
    dp = F.datediff("date", F.col("p.d"))
    dn = F.datediff(F.col("n.d"), "date")
    pick_prev = F.col("n.d").isNull() | (F.col("p.d").isNotNull() & (dp <= dn))
    return lk.select("date",
                     F.when(pick_prev, F.col("p.d")).otherwise(F.col("n.d")).alias("nearest_date"),
                     F.when(pick_prev, F.col("p.v")).otherwise(F.col("n.v")).alias(value))


def nearest_date(df: DataFrame, series: DataFrame, date_col: str = "date",
                 value: str = "fuel_price_usd_per_barrel", out_col: str | None = None) -> DataFrame:
    """As-of join to the nearest series day in either direction."""
    days = df.select(F.to_date(F.col(date_col)).alias("date"))
    table = nearest_value_table(days, series, value).withColumnRenamed("date", "_nd")
    out = df.join(F.broadcast(table), F.to_date(F.col(date_col)) == F.col("_nd"), "left").drop("_nd")
    return out.withColumnRenamed(value, out_col) if out_col else out


def enrich_fares(df: DataFrame, series: DataFrame, calendar: DataFrame, date_col: str = "date") -> DataFrame:
    """Series values, holiday flag and score, holiday-season flag (date kept)."""
    out = join_daily_series(df, series, date_col)
    out = holiday_exact(out, calendar, date_col).drop("holiday_name")
    out = holiday_window(out, calendar, date_col).drop("days_to_holiday", "season_holiday_name",
                                                       "holiday_impact", "season_type")
    return out
