"""Flagship report: peak and off-peak months of every route.

fares -> daily index (left join) -> calendar parts -> monthly mean / std /
count per route -> the three highest and lowest months per route.

One pass over the fare rows: the monthly aggregate (partial aggregation on
the map side) is ranked both ways in one window pass and carries its
standard deviation and count along, so the fare join is never re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelens.operators.analytics import monthly_stats, peak_months, with_route
from farelens.operators.enrich import join_daily_series
from farelens.operators.features import temporal_features
from farelens.sources import tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    fares = tables.fares(spark, sf_dir)
    series = tables.fuel_series(spark, sf_dir)
    enriched = with_route(temporal_features(join_daily_series(fares, series)))
    monthly = monthly_stats(enriched)
    return peak_months(monthly, keep=("std_price", "n")).select(
        "route", "month", "kind", "rank", "mean_price", "std_price", "n")
