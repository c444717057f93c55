"""Binning expressions.

``right_closed_band`` follows interval bins that include the right edge and
exclude the left one: a value equal to the lowest edge gets no band (null),
exactly like right-closed cut bins. ``Bucketizer`` is left-closed, so it is
not used.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def right_closed_band(value: Column, bands, *, as_index: bool = False) -> Column:
    """``bands`` is a list of ``(lo, hi, label)``; ``hi=None`` means no upper edge."""
    expr = None
    for i, (lo, hi, label) in enumerate(bands):
        cond = value > F.lit(lo)
        if hi is not None:
            cond = cond & (value <= F.lit(hi))
        out = F.lit(i) if as_index else F.lit(label)
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return expr


def band_rank(label: Column, bands) -> Column:
    """Position of a band label in ``bands`` (for ordered output)."""
    expr = None
    for i, (_, _, name) in enumerate(bands):
        expr = F.when(label == F.lit(name), F.lit(i)) if expr is None else expr.when(label == F.lit(name), F.lit(i))
    return expr


def equal_width_bin(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """1-based index of ``n`` equal-width bins over ``[lo, hi]``.

    The lowest bin includes the minimum (its left edge is moved down), bins are
    right-closed otherwise; ``hi == lo`` puts everything in bin 1.
    """
    width = (hi - lo) / F.lit(float(n))
    raw = F.ceil((value - lo) / F.when(width == 0, F.lit(None)).otherwise(width))
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(n), raw)), F.lit(1)).cast("int")
