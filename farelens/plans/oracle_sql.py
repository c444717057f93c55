"""Oracle SQL per registered query (DuckDB dialect; the driver tables are views)."""

from __future__ import annotations

from farelens.plans.catalog import SQL

__all__ = ["SQL"]
