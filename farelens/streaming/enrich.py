"""Stream-static use of the row-local operators.

Nothing here is a new operator: the same functions that build the batch
feature table are applied to a streaming DataFrame. The daily series and the
calendar are static lookup tables (one row per day), so the enrichment joins
are stream-static broadcast joins and need no state. Group counts (route
popularity, carrier share) are aggregates over the whole table and are taken
from a batch fit, passed in as static tables; the label vocabulary and the
scaler come from the fitted preparation state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from farelens.operators import clean as P
from farelens.operators import encode as M
from farelens.operators.enrich import enrich_fares
from farelens.operators.stats import bounded_broadcast
from farelens.operators.features import (airline_features, duration_features, route_features, temporal_features,
                                         time_features)


def enrich_stream(stream: DataFrame, series: DataFrame, calendar: DataFrame, route_counts: DataFrame,
                  carrier_counts: DataFrame) -> DataFrame:
    """Features and enrichment of fare rows arriving on a stream.

    ``route_counts`` is ``(_k0, _k1, _cnt)`` and ``carrier_counts`` is
    ``(_airline, airline_market_share)``, as returned by
    ``features.route_and_carrier_counts`` on the batch table. Both are
    broadcast only after their written size is checked; a larger table stays
    a stream-static shuffle join.
    """
    out = P.add_time_taken(P.clean_time_labels(stream))
    out = temporal_features(out)
    out = route_features(out, counts=bounded_broadcast(route_counts))
    out = time_features(out)
    out = duration_features(out)
    out = airline_features(out, counts=bounded_broadcast(carrier_counts))
    return enrich_fares(out, series, calendar)


def score_stream(features: DataFrame, state: dict, model) -> DataFrame:
    """Encode, fill and scale with the fitted state, assemble, and score with a fitted model."""
    from farelens.operators.models import assemble
    x = M.transform_matrix(features, state, keep=("fare_key", "price"))
    return model.transform(assemble(x, state["feature_columns"])).select("fare_key", "price", "prediction")
