"""Exact money aggregates.

Means of cent values land on exact decimal ties often enough that two engines
round them differently. Summing integer cents and dividing once at the end
gives the same double everywhere (one correctly rounded division).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cents(price: Column) -> Column:
    return F.round(price * F.lit(100)).cast("bigint")


def mean_from_cents(sum_cents: Column, n: Column) -> Column:
    return sum_cents.cast("double") / (n * F.lit(100)).cast("double")


def mean_price(price: Column) -> Column:
    """Aggregate: mean of a money column via integer cents."""
    return mean_from_cents(F.sum(cents(price)), F.count(price))


def round_binary(x: Column, digits: int = 2) -> Column:
    """Round the binary value half away from zero (``floor(|x|*10^d + 0.5)``).

    ``F.round`` rounds the shortest decimal text of a double, so ``283.465``
    (stored as 283.46499999999997) becomes 283.47; rounding the stored value
    gives 283.46, as Python's ``round`` and most SQL engines do.
    """
    scale = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
