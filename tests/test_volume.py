"""What the shared steps of the fare queries shuffle and write."""

from __future__ import annotations

import contextlib
import datetime
import io
import re
from collections import Counter

from pyspark.sql import functions as F

from farelens.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from farelens.functions.text import format_duration
from farelens.operators import analytics as A
from farelens.operators import encode as M
from farelens.operators import models as ML
from farelens.operators import scoring as SC
from farelens.operators import stats as S
from farelens.sources import tables


def _star(spark, folder) -> str:
    day = datetime.date(1995, 3, 1)
    rows = {
        "nation": ([(0, "PERU"), (1, "CHINA")], "n_nationkey int, n_name string"),
        "supplier": ([(1, 0), (2, 1), (2, 1), (None, 0)], "s_suppkey long, s_nationkey int"),
        "customer": ([(1, 1, "BUILDING"), (2, None, "HOUSEHOLD"), (3, 0, None)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(1, "Brand#1", 5, 10.0), (None, "Brand#2", 6, 11.0)], "p_partkey long, p_brand string, p_size int, p_retailprice double"),
        "orders": ([(1, 1, day, "1-URGENT"), (1, 1, day, "5-LOW"), (2, 2, day, "2-HIGH"), (3, 3, day, None), (None, 1, day, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string"),
        "lineitem": ([(o, p, s, n, 4.0, 100.0, 0.1, "R", "F", day) for n, (o, p, s) in enumerate(
            [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 1), (3, None, 1), (None, 1, 1), (3, 1, None)])],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_returnflag string, l_linestatus string, l_shipdate date"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_fare_rows_meet_only_parts_and_orders_in_a_shuffle(spark, tmp_path):
    d = _star(spark, tmp_path / "star")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(held, ("-1", "false")):
            spark.conf.set(k, v)
        fares = tables.fares(spark, d)
        plan = fares._jdf.queryExecution().executedPlan().toString()
        got = Counter((r["fare_key"], r["from"], r["to"], r["dep_time"]) for r in fares.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "hashpartitioning(l_suppkey" not in plan
    # customers are joined below the join on the order key
    assert plan.index("[l_orderkey") < plan.index("[o_custkey")
    # orders and suppliers with repeated keys repeat the fare, null keys meet nothing
    assert got == Counter({
        ("1|0|1|1|1995-03-01", "PERU", "CHINA", "Early_Morning"): 1, ("1|0|1|1|1995-03-01", "PERU", "CHINA", "Late_Night"): 1,
        ("1|1|1|2|1995-03-01", "CHINA", "CHINA", "Early_Morning"): 2, ("1|1|1|2|1995-03-01", "CHINA", "CHINA", "Late_Night"): 2,
        ("3|3|1|1|1995-03-01", "PERU", "PERU", None): 1})


def test_duration_text_needs_no_formatter(spark):
    hours = [0.0, 0.1, 1.5, 9.99, 12.25, 100.0, -1.5, -0.25, -1e-20, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(h,) for h in hours], "h double")
    whole = F.floor("h")
    old = F.when(F.col("h").isNull(), F.lit("2h 00m")).otherwise(F.format_string(
        "%dh %02dm", whole.cast("bigint"), F.floor((F.col("h") - whole) * F.lit(60)).cast("bigint")))
    out = df.select(format_duration(F.col("h")).alias("new"), old.alias("old"))
    assert all(r["new"] == r["old"] for r in out.collect())
    assert "format_string" not in df.select(format_duration(F.col("h")))._jdf.queryExecution().optimizedPlan().toString()


def test_value_histogram_counts_by_position(spark):
    data = [("a", "x", 1.0, 1), ("a", None, None, 2), (None, "x", float("nan"), 1), ("b", "x", 1.0, None), ("b", "y", -0.0, 0), ("b", "y", 0.0, 0)]
    df = spark.createDataFrame(data, "s1 string, s2 string, v1 double, v2 int")
    for label in (None, "nan"):
        hist = S.value_histogram(df, ["s1", "s2"], ["v1", "v2"], null_label=label)
        assert hist.columns == ["column", "s", "v", "cnt"]
        got = {(r["column"], r["s"], repr(r["v"])): r["cnt"] for r in hist.collect()}
        want = Counter()
        for row in data:
            for c, x in zip(("s1", "s2"), row[:2]):
                if x is not None or label is not None:
                    want[c, label if x is None else x, "None"] += 1
            for c, x in zip(("v1", "v2"), row[2:]):
                want[c, None, repr(None if x is None else float(x) + 0.0)] += 1
        assert got == dict(want)
        assert "posexplode" in hist._jdf.queryExecution().optimizedPlan().toString()
    assert S.value_histogram(df, [], ["v1"]).count() == 4 and S.value_histogram(df, ["s1"]).count() == 2


def test_written_tables_are_small(spark, tmp_path):
    df = spark.range(0, 20000, 1, 1).select(F.md5(F.col("id").cast("string")).alias("k"))
    df.write.option("compression", "snappy").parquet(str(tmp_path / "plain"))
    assert S.written_bytes(S.materialize(df, "small-test")) < 0.7 * S.written_bytes(spark.read.parquet(str(tmp_path / "plain")))


def test_fitted_features_hold_the_matrix_only(spark, monkeypatch):
    from farelens.plans import q_matrix as Q
    cols = [F.col("id").cast("double").alias(c) for c in Q.NUMERIC_FEATURES] + [F.col("id").cast("string").alias(c) for c in Q.CATS]
    table = spark.range(5).select(F.col("id").cast("string").alias("fare_key"), F.lit(1.0).alias("price"), *cols, F.lit("x").alias("flight"))
    monkeypatch.setattr(Q, "feature_table", lambda spark, d, extra: table)
    feats, state = Q.fitted(spark, "none")
    assert feats.columns == ["fare_key", "price", *Q.NUMERIC_FEATURES, *Q.CATS] and state["feature_columns"] == Q.MATRIX
    assert feats.count() == 5


def _method_sizes(df) -> list[int]:
    """Bytes of the longest method of every generated class of ``df``'s plan."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]


def test_matrix_compiles_to_methods_that_the_jvm_compiles(spark, tmp_path):
    numbers = {c: [1.0, 2.5, None, 4.0] for c in NUMERIC_FEATURES}
    labels = {c: ["a", "b", None, "b"] for c in CATEGORICAL_FEATURES}
    names = ["fare_key", *numbers, *labels]
    rows = [tuple([f"k{i}", *[v[i] for v in numbers.values()], *[v[i] for v in labels.values()]]) for i in range(4)]
    schema = "fare_key string, " + ", ".join(f"`{c}` {'double' if c in numbers else 'string'}" for c in names[1:])
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "features"))
    feats = spark.read.parquet(str(tmp_path / "features"))
    state = M.fit_matrix_state(feats)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        matrix = M.transform_matrix(feats, state)
        training = ML.assemble(M.split_rows(matrix), state["feature_columns"]).select("fare_key", "split", "features")
        scored = SC.fitted_vector(feats, state, cut=True)
        sizes = [_method_sizes(df) for df in (matrix, training, scored)]
        assert all(sizes) and max(map(max, sizes)) <= 8000
        # absent and unseen values, and the same numbers on both ways
        seen = spark.createDataFrame([("u", "zz", 3.0), ("v", None, None)], "fare_key string, airline string, year double")
        got = {r["fare_key"]: r["_features"].toArray() for r in SC.fitted_vector(seen, state).collect()}
        by_key = {r["fare_key"]: r for r in matrix.collect()}
        vectors = {r["fare_key"]: r["features"].toArray().tolist() for r in training.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    at = {c: i for i, c in enumerate(state["feature_columns"])}
    # year: median 2.5, quartiles of (1, 2.5, 2.5, 4) are 2.125 and 2.875; airline: a=0, b=1, nan=2 (0, 1, 1, 2: quartiles 0.75, 1.25)
    assert [by_key[f"k{i}"]["year"] for i in range(4)] == [-2.0, 0.0, 0.0, 2.0]
    assert [by_key[f"k{i}"]["airline_encoded"] for i in range(4)] == [-2.0, 0.0, 2.0, 0.0]
    assert all(vectors[k] == [by_key[k][c] for c in state["feature_columns"]] for k in by_key)
    assert (got["u"][at["year"]], got["u"][at["airline_encoded"]]) == ((3.0 - 2.5) / 0.75, 4.0)
    assert (got["v"][at["year"]], got["v"][at["airline_encoded"]], got["v"][at["from_encoded"]]) == (0.0, 2.0, 0.0)


def test_sequence_rows_carry_their_order_columns_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(A, "materialize", lambda df, name="table": written.append(df.columns) or S.materialize(df, name))
    rows = [("r", d, f"k{d}", float(d), float(10 * d)) for d in range(5)] + [("q", 1, "k1", 7.0, 70.0)] + [(None, d, f"n{d}", 1.0, 1.0) for d in range(4)]
    df = spark.createDataFrame(rows, "route string, day int, fare_key string, price double, duration double")
    out = A.sequence_windows(df, ["route"], ["day", "fare_key"], ["price", "day"], "price", length=2, bucket_rows=2)
    carried = ["route", "price", "duration", "_okey"]
    assert written == [carried, [*carried, "_pid"]]
    assert out.columns == ["route", "day", "fare_key", "price", "duration", "_pos", "sequence"]
    got = sorted((r["day"], r["fare_key"], r["price"], r["duration"], r["_pos"], r["sequence"]) for r in out.collect())
    assert got == [(d, f"k{d}", float(d), 10.0 * d, d, [[d - 2.0, d - 2.0], [d - 1.0, d - 1.0]]) for d in (2, 3, 4)]
