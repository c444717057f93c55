"""The row-local stages run on a stream and agree with the batch result."""

from pyspark.sql import functions as F

from farelens.operators.features import feature_engineering, route_and_carrier_counts
from farelens.operators.enrich import enrich_fares
from farelens.operators.stats import materialize
from farelens.plans import base
from farelens.streaming import enrich_stream
from farelens.streaming.enrich import score_stream

SF = "/root/testdata/sf0.001"


def test_stream_enrichment_matches_batch(spark):
    fares = materialize(base.fares(spark, SF), "stream-source")
    path = fares.inputFiles()[0].rsplit("/", 1)[0]
    series, cal = base.series(spark, SF), base.calendar(spark)
    from farelens.plans.base import standardized
    batch = feature_engineering(standardized(spark, SF), enrich=lambda df: enrich_fares(df, series, cal))
    routes, carriers = route_and_carrier_counts(fares)
    stream = spark.readStream.schema(fares.schema).parquet(path)
    q = (enrich_stream(stream, series, cal, routes, carriers).writeStream.format("memory")
         .queryName("enriched_stream").outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("enriched_stream")
    cols = ["fare_key", "route_popularity", "airline_market_share", "dep_time_slot", "total_flight_minutes",
            "fuel_price_usd_per_barrel", "is_holiday", "is_holiday_season", "week_of_year"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0


def test_stream_scores_equal_batch_scores(spark):
    """M10 on a stream: the fitted state and a trained model score arriving rows as they score the table."""
    from farelens.operators import encode as M
    from farelens.operators import models as ML
    from farelens.plans.q_features import feature_table
    feats = materialize(feature_table(spark, SF), "stream-features")
    state = M.fit_matrix_state(feats)
    table = ML.assemble(M.transform_matrix(feats, state), state["feature_columns"])
    model = ML.train_ridge(table)
    path = feats.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(feats.schema).parquet(path)
    q = score_stream(stream, state, model).writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table("scored_stream").collect())
    want = sorted(tuple(r) for r in model.transform(table).select("fare_key", "price", "prediction").collect())
    assert got == want and len(got) > 0
