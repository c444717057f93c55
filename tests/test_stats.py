"""Exact distributed quantiles, modes and ranks against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from farelens.operators.stats import (bounded_broadcast, column_modes, exact_quantiles, quantiles_from_histogram, rank_intervals,
                                      value_histogram)


def _linear(values, q):
    v = np.sort(np.asarray(values, dtype=float))
    h = (len(v) - 1) * q
    lo, hi = int(np.floor(h)), int(np.ceil(h))
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


def test_quantiles_match_brute_force_with_a_hot_group(spark):
    rng = np.random.default_rng(7)
    # one group holds most rows: it must still be ranked across partitions
    groups = ["hot"] * 3000 + ["a"] * 40 + ["b"] * 7 + ["c"]
    vals = rng.integers(0, 500, len(groups)).astype(float)
    pdf = pd.DataFrame({"g": groups, "x": vals})
    df = spark.createDataFrame(pdf).repartition(6)
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p90": 0.9}
    got = {r["g"]: r for r in exact_quantiles(df, "x", probs, by=["g"], num_partitions=5).collect()}
    for g, sub in pdf.groupby("g"):
        for name, q in probs.items():
            assert abs(got[g][name] - _linear(sub["x"], q)) < 1e-9, (g, name)


def test_quantiles_ignore_nulls_and_single_values(spark):
    df = spark.createDataFrame([(1, None), (1, 5.0), (2, None)], "g int, x double")
    rows = {r["g"]: r["m"] for r in exact_quantiles(df, "x", {"m": 0.5}, by=["g"]).collect()}
    assert rows == {1: 5.0}


def test_rank_intervals_cover_every_rank_once(spark):
    hist = spark.createDataFrame([("k", float(v), c) for v, c in [(1, 3), (2, 1), (5, 2), (9, 4)]],
                                 "g string, v double, cnt long")
    r = sorted(rank_intervals(hist, ["g"], "v", num_partitions=3).collect(), key=lambda x: x["v"])
    assert [(x["_lo"], x["_hi"]) for x in r] == [(0, 2), (3, 3), (4, 5), (6, 9)]
    assert all(x["_n"] == 10 for x in r)


def test_histogram_quantiles_equal_row_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 20, 400).astype(float), "y": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    hist = value_histogram(df, numeric_cols=["x", "y"])
    got = {r["column"]: r["q"] for r in quantiles_from_histogram(hist, ["column"], "v", {"q": 0.3}).collect()}
    assert abs(got["x"] - _linear(pdf["x"], 0.3)) < 1e-9
    assert abs(got["y"] - _linear(pdf["y"], 0.3)) < 1e-9


def test_modes_break_ties_by_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "s string")
    assert column_modes(df, ["s"]).collect()[0]["mode"] == "a"


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    """Half a million distinct values in three groups, with reuse of shuffles switched off."""
    before = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        n = 510_000
        hist = spark.range(n).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"),
                                     F.lit(1).alias("cnt")).dropDuplicates(["g", "v"])
        got = rank_intervals(hist, ["g"], "v", num_partitions=16).toPandas().sort_values(["g", "v"])
        for _, sub in got.groupby("g"):
            assert (sub["_lo"].to_numpy() == np.arange(len(sub))).all()
            assert (sub["_hi"] == sub["_lo"]).all() and (sub["_n"] == len(sub)).all()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_broadcast_is_decided_by_written_bytes(spark):
    df = spark.range(5000)
    small, large = bounded_broadcast(df), bounded_broadcast(df, max_bytes=10)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()
    assert small.count() == large.count() == 5000
