"""Shared inputs of the registered queries: fare views, series, calendar, enriched fares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.operators.analytics import with_route
from farelens.operators.enrich import enrich_fares
from farelens.sources import tables
from farelens.sources.calendar import build_calendar


def fares(spark: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return tables.fares(spark, d, extra)


def fares_dirty(spark: SparkSession, d: str) -> DataFrame:
    return tables.fares_dirty(spark, d)


def series(spark: SparkSession, d: str) -> DataFrame:
    return tables.fuel_series(spark, d)


def calendar(spark: SparkSession) -> DataFrame:
    return build_calendar(spark)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Fares + daily index + holiday flags + ``route``."""
    return with_route(enrich_fares(fares(spark, d), series(spark, d), calendar(spark)))


def standard_union(spark: SparkSession, d: str) -> DataFrame:
    """U1 over the three file layouts, each standardised first."""
    from farelens.operators import clean as P
    return P.union_fares(P.standardize_clean(tables.clean_file(spark, d)),
                         P.standardize_business(tables.business_file(spark, d)),
                         P.standardize_economy(tables.economy_file(spark, d)))


def standardized(spark: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Fares with unified time labels and ``time_taken`` text (input of the feature chain)."""
    from farelens.operators import clean as P
    return P.add_time_taken(P.clean_time_labels(fares(spark, d, extra)))
