"""Dictionary lookups as literal maps (evaluated inside codegen, no join)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """``mapping[key]`` with ``default`` for missing keys or a null key.

    A null key is handled before the map access: map lookups reject null keys.
    """
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    value = F.when(key.isNull(), F.lit(None)).otherwise(F.try_element_at(F.create_map(*pairs), key))
    return value if default is None else F.coalesce(value, F.lit(default))


def relabel(col: Column, mapping: dict) -> Column:
    """Replace values found in ``mapping``; keep all others unchanged."""
    return F.coalesce(lookup(col, mapping), col)
