"""Calendar expressions (day grain)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farelens.constants import SEASON_CODES, SEASONS
from farelens.functions.lookups import lookup


def date_parts(d: Column) -> dict[str, Column]:
    """Year, month, quarter, day, Monday=0 weekday, day of year, ISO week."""
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
    }


def season_name(month: Column, seasons: dict | None = None) -> Column:
    return lookup(month, seasons or SEASONS)


def season_code(month: Column, seasons: dict | None = None) -> Column:
    seasons = seasons or SEASONS
    codes = {m: SEASON_CODES[s] for m, s in seasons.items()}
    return lookup(month, codes, default=0)


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")
