"""All registered queries (importing the query modules fills the registry).

Every query reads the driver tables (through the fare views) over whole
tables; computed columns carry the same names as in the oracle SQL.
"""

from __future__ import annotations

from farelens.plans import (q_analytics, q_booking, q_clean, q_enrich, q_features,  # noqa: F401
                            q_matrix, q_models, q_scored, q_sinks)
from farelens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
