"""String cleaning and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def carrier_code(airline: Column) -> Column:
    """First two letters of the carrier name."""
    return F.substring(airline, 1, 2)


def flight_number(flight: Column) -> Column:
    """First digit run of the flight code, ``'000'`` when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(flight, r"(\d+)", 1), F.lit("")), F.lit("000"))


def format_duration(hours: Column) -> Column:
    """Decimal hours -> ``'Xh MMm'`` (minutes truncated); null -> ``'2h 00m'``."""
    h = F.floor(hours)
    m = F.floor((hours - h) * F.lit(60))
    minutes = m.cast("bigint")
    pad = F.when((minutes >= 0) & (minutes < 10), F.lit("h 0")).otherwise(F.lit("h "))
    return F.when(hours.isNull(), F.lit("2h 00m")).otherwise(
        F.concat(h.cast("bigint").cast("string"), pad, minutes.cast("string"), F.lit("m")))


def standard_duration(duration: Column, is_text: bool = False) -> Column:
    """Numeric (or numeric text) hours are formatted; other text stays as it is."""
    if not is_text:
        return format_duration(duration)
    num = duration.try_cast("double")
    return (F.when(duration.isNull(), F.lit("2h 00m"))
            .when(num.isNotNull(), format_duration(num))
            .otherwise(duration))


def parse_dmy(text: Column) -> Column:
    """``dd-mm-yyyy`` text -> date; malformed text -> null."""
    return F.try_to_date(text, "dd-MM-yyyy")


def parse_price_text(text: Column) -> Column:
    """Remove thousands commas and quotes, then read a number (bad -> null)."""
    return F.regexp_replace(text, r"[,\"]", "").try_cast("double")


def digits_and_dot(text: Column) -> Column:
    """Keep only digits and dots, then read a number (bad or empty -> null)."""
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
