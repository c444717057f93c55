"""M6: the full preparation chain of the fare table.

load -> clean (P16) -> features (F13, with the daily series and calendar) ->
encode (M1) -> matrix (M3) -> robust scale (M4) -> split (M5) -> write by split (S8)
and save the fitted state (S9).

Passes over the fare rows: the seven-way join and de-duplication (written),
one histogram for the fill values, the cleaned table (written), one
aggregate for the route and carrier counts, the feature table (written),
one histogram for vocabularies + medians + scaler statistics, and the final
encode/fill/scale/split pass that writes the matrix partitioned by split.
Every fitted statistic is read from a small written histogram, and a lost
executor only recomputes from the last written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelens.operators import clean as P
from farelens.operators import encode as M
from farelens.operators.enrich import enrich_fares
from farelens.operators.features import feature_engineering
from farelens.session import scratch_path, scratch_scope
from farelens.sources import files


def prepare(spark: SparkSession, raw: DataFrame, series: DataFrame, calendar: DataFrame, *,
            price_source: str = "price", out_path: str | None = None, state_path: str | None = None,
            fit_on: str = "all", counts: P.StepCounts | None = None) -> dict:
    """The whole chain; ``fit_on="train"`` fits vocabularies, medians and scaler on the training rows only.

    The tables of the cleaning steps are deleted once the feature table is written.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    with scratch_scope(spark) as made:
        cleaned = P.clean_fares(raw, price_source=price_source, counts=counts)
        if "time_taken" not in cleaned.columns and "duration" in cleaned.columns:
            cleaned = P.add_time_taken(cleaned)
        feats = feature_engineering(cleaned, enrich=lambda df: enrich_fares(df, series, calendar))
        kept = scratch_path(spark, "features")
        made.remove(kept)
        feats.write.parquet(kept)
    feats = spark.read.parquet(kept)
    fit_rows = feats if fit_on == "all" else M.split_rows(feats).where("split = 'train'").drop("split")
    state = M.fit_matrix_state(fit_rows)
    split = M.split_rows(M.transform_matrix(feats, state))
    out_path = out_path or scratch_path(spark, "prepared")
    state_path = state_path or scratch_path(spark, "prep-state")
    written = files.write_splits(split, out_path)
    files.save_matrix_state(spark, state_path, state)
    return {"table": written, "feature_columns": state["feature_columns"], "vocab": state["vocab"],
            "scaler": state["scaler"], "medians": state["medians"], "path": out_path, "state_path": state_path,
            "features": feats}
