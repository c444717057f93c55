"""Trained models behind booking, fuel and quote reports; prefix grid; concurrent training; publishing; step counts."""

import json
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farelens.operators import booking as B
from farelens.operators import clean as P
from farelens.operators import encode as M
from farelens.operators import models as ML
from farelens.operators import scoring as SC
from farelens.sources import files

NUMERIC = ["month", "fuel_price_usd_per_barrel", "fuel_price_inr_per_liter", "duration"]


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    n = 600
    fuel = rng.uniform(50, 120, n)
    pdf = pd.DataFrame({"fare_key": [f"k{i}" for i in range(n)], "month": rng.integers(1, 13, n), "fuel_price_usd_per_barrel": fuel,
                        "fuel_price_inr_per_liter": fuel * 0.53, "duration": rng.uniform(1, 9, n), "airline": rng.choice(["A", "B", "C"], n)})
    pdf["price"] = 900 + 20 * fuel + 50 * pdf.duration + 300 * (pdf.airline == "B") + rng.normal(0, 5, n)
    pdf.loc[::17, "duration"] = None
    df = spark.createDataFrame(pdf).withColumn("duration", F.nanvl("duration", F.lit(None))).cache()
    state = M.fit_matrix_state(df, numeric=NUMERIC, categorical=["airline"])
    train = ML.assemble(M.transform_matrix(df, state), state["feature_columns"]).cache()
    return df, state, train, ML.train_ridge(train)


def test_requests_go_through_the_fitted_state(spark, trained):
    df, state, train, model = trained
    whole = SC.score_models(df, {"ridge": model}, state).select("fare_key", "pred_ridge")
    direct = ML.predict(model, train, "m").select("fare_key", "prediction")
    assert whole.join(direct, "fare_key").where(F.abs(F.col("pred_ridge") - F.col("prediction")) > 1e-9).count() == 0
    request = spark.createDataFrame([(1, 3, 80.0, "B"), (2, 3, None, "new"), (3, None, 80.0, None)],
                                    "id int, month int, fuel_price_usd_per_barrel double, airline string")
    got = SC.score_models(request, {"ridge": model}, state, {"duration": 2.5})
    assert got.columns == [*request.columns, "pred_ridge"]
    hand = SC.by_coefficients(request, SC.coefficient_table(model, state), state, model.intercept, ["id"], {"duration": 2.5})
    both = got.join(hand, "id").collect()
    assert len(both) == 3 and all(abs(r.pred_ridge - r.by_hand) < 1e-6 for r in both)
    with pytest.raises(ValueError, match="in the rows"):
        SC.score_models(got, {"ridge": model}, state)
    with pytest.raises(ValueError, match="no fitted"):
        SC.score_models(got, {}, state)


class _Odd:
    """Stands in for a model that gives no usable price for some rows."""
    featuresCol, predictionCol = "featuresCol", "predictionCol"

    def copy(self, extra):
        self.out = extra["predictionCol"]
        return self

    def transform(self, df):
        price = F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 2, F.lit(float("nan"))).when(F.col("id") == 3, F.lit(-5.0)).otherwise(F.lit(42.0))
        return df.withColumn(self.out, price.cast("double"))


def test_pattern_price_stands_in_where_the_model_gives_none(spark, trained):
    _, state, _, _ = trained
    rows = spark.createDataFrame([(i, 100.0 + i) for i in range(1, 5)], "id int, pattern_price double")
    got = {r.id: (r.predicted_price, r.price_source) for r in SC.model_scorer(_Odd(), state, fallback=F.col("pattern_price"))(rows).collect()}
    assert got == {1: (101.0, "pattern"), 2: (102.0, "pattern"), 3: (103.0, "pattern"), 4: (42.0, "model")}


def test_what_if_needs_one_shuffle_and_equals_the_joined_form(spark, trained):
    _, state, _, model = trained
    base = spark.createDataFrame([(f"r{i}", i % 12 + 1, 60.0 + i, "AB"[i % 2]) for i in range(30)],
                                 "route string, month int, fuel_price_usd_per_barrel double, airline string")
    score = SC.model_scorer(model, state, {"duration": 2.5})
    got = SC.fuel_what_if(base, score, ["route"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(route") == 1 and "SortMergeJoin" not in plan
    old = B.fuel_impact(B.fuel_scenarios(base.withColumn("base_fuel_price", F.col("fuel_price_usd_per_barrel"))), score)
    key = lambda r: (r.route, r.fuel_price)
    a, b = sorted(got.collect(), key=key), sorted(old.collect(), key=key)
    assert len(a) == len(b) == 30 * 7
    for x, y in zip(a, b):
        assert key(x) == key(y)
        for c in ("predicted_price", "fuel_change_pct", "price_impact_pct", "elasticity", "baseline_price"):
            assert abs(x[c] - y[c]) < 1e-7, c


def test_ensemble_weights_come_from_the_stored_metrics(spark, trained, tmp_path):
    df, state, train, ridge = trained
    models = {"ridge": ridge, "boosted": ML.train_boosted(train, max_iter=4, max_depth=3), "forest": ML.train_forest(train, num_trees=4, max_depth=4)}
    for name, m in models.items():
        ML.save_model(m, f"{tmp_path}/{name}")
    loaded = {name: ML.load_model(f"{tmp_path}/{name}") for name in models}
    metrics = ML.regression_metrics(ML.score_long(models, train.withColumn("split", F.lit("val"))))
    out = SC.ensemble_predictions(df, loaded, state, metrics).collect()
    rmse = {r.model: r.rmse for r in metrics.collect()}
    for r in out:
        p = np.array([r.pred_ridge, r.pred_boosted, r.pred_forest])
        w = np.array([1 / (rmse[m] + 1e-8) for m in models])
        assert np.allclose([r.ensemble_average, r.ensemble_weighted, r.ensemble_median], [p.mean(), (p * w).sum() / w.sum(), np.median(p)])
    with pytest.raises(ValueError, match="metrics"):
        SC.stored_weights(metrics, ["ridge", "other"])


def test_first_rounds_equal_a_shorter_fit(trained):
    _, _, train, _ = trained
    long = ML.train_boosted(train, max_iter=6, max_depth=3)
    short = ML.train_boosted(train, max_iter=3, max_depth=3)
    cut = ML.first_rounds(long, 3)
    assert cut.getNumTrees == 3 and list(cut.treeWeights) == list(short.treeWeights)
    a = ML.predict(cut, train, "m").orderBy("fare_key").collect()
    assert a == ML.predict(short, train, "m").orderBy("fare_key").collect()
    with pytest.raises(ValueError):
        ML.first_rounds(long, 7)


def test_prefix_grid_equals_separate_fits(trained):
    _, _, train, _ = trained
    val = train.where(F.col("fare_key") > "k4")
    grid = {"maxDepth": [2, 3], "maxIter": [2, 5], "stepSize": [0.1]}
    table, best = ML.grid_tune(train, val, grid=grid, parallelism=2)
    rows = {r.grid_index: r for r in table.collect()}
    assert len(rows) == 4 and sum(r.best for r in rows.values()) == 1
    for r in rows.values():
        p = json.loads(r.params)
        alone = ML.GBTRegressor(featuresCol="features", labelCol="price", seed=42, **p).fit(train)
        m = ML.regression_metrics(ML.predict(alone, val, "m")).first()
        assert abs(m.rmse - r.rmse) < 1e-6 * m.rmse
    assert best["model"].getNumTrees == best["best_params"]["maxIter"]


def test_training_runs_at_the_same_time_and_can_be_cancelled(trained):
    _, _, train, _ = trained
    met = threading.Barrier(2, timeout=60)

    def slow(df, label="price", **_):
        met.wait()                                       # both fits must be running to pass
        return ML.train_ridge(df, label)

    def endless(df, label="price", **_):
        while True:                                      # one core at a time
            df.sparkSession.range(0, 20, 1, 1).where("java_method('java.lang.Thread', 'sleep', id * 0 + 200L) is null").count()

    models, metrics, errors = ML.train_all(train, train, trainers={"a": slow, "b": slow})
    assert set(models) == {"a", "b"} and not errors and metrics.count() == 4
    t0 = time.time()
    models, metrics, errors = ML.train_all(train, train, trainers={"a": lambda df, label: ML.train_ridge(df, label), "b": endless}, timeout=20)
    assert set(models) == {"a"} and errors["b"].startswith("TimeoutError") and time.time() - t0 < 90
    report = {(r.model, r.split): r.error for r in ML.training_report(metrics, errors).collect()}
    assert report[("b", None)].startswith("TimeoutError") and report[("a", "val")] is None


def test_steps_are_counted_by_the_jobs_that_clean(spark):
    rows = [(i, "A", "X", "Y", "Economy", "zero", "Morning", "Night", 5000.0 + i, 2.0) for i in range(40)]
    rows += [rows[0], rows[1], (90, None, "X", "Y", "Economy", None, None, "Late_Night", -0.0, 3.0), (91, "A", "X", "Y", "Economy", "zero", "M", "N", 9e9, 2.0)]
    df = spark.createDataFrame(rows, "fare_key int, airline string, `from` string, `to` string, class string, stop string, dep_time string, "
                                     "arr_time string, price double, duration double").repartition(5)
    counts = P.StepCounts()
    out = P.clean_fares(df, counts=counts)
    n = out.write.format("noop").mode("overwrite").save()
    got = [tuple(r) for r in counts.table(spark).orderBy("position").collect()]
    assert n is None and got == [(1, "duplicates", 44, 42, 2), (2, "price", 42, 41, 1), (3, "outliers", 41, 40, 1)]
    assert out.count() == 40


def test_calendar_files_keep_their_order_and_their_bad_rows(spark, tmp_path):
    head = "date,holiday_name,is_national_holiday,holiday_type,year,holiday_impact_score\n"
    (tmp_path / "a.csv").write_text(head + "2001-01-26,Republic Day,true,National,2001,3.0\n2001-13-40,Nowhere,true,National,2001,3.0\n"
                                    "2001-01-01 00:00:00,New Year,true,National,2001,4.0\n\n")
    (tmp_path / "b.csv").write_text(head + "2001-10-02,Dussehra,false,Festival,2001,4.0\r\n2001-10-03,Odd,maybe,Festival,20x1,4.0\n,No date,true,National,2001,1.0\n")
    good = files.read_calendar(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, str(r.date), r.holiday_name) for r in good] == [(0, "2001-01-26", "Republic Day"), (1, "2001-01-01", "New Year"), (2, "2001-10-02", "Dussehra")]
    bad = sorted((r.file, r.line, r.text) for r in files.rejected_rows(spark, str(tmp_path)).collect())
    assert [(f, line) for f, line, _ in bad] == [("a.csv", 2), ("b.csv", 2), ("b.csv", 3)] and bad[0][2].startswith("2001-13-40")


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert files.publish(spark.range(5), path)
    broken = spark.range(9).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        files.publish(broken, path)
    assert spark.read.parquet(path).count() == 5
    assert files.publish(spark.range(7), path) and spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_of_two_builders_one_wins(spark, tmp_path):
    path, met, got = f"{tmp_path}/t", threading.Barrier(2, timeout=60), {}

    def build(n):
        met.wait()                                       # both have found no table
        return spark.range(n)

    threads = [threading.Thread(target=lambda n=n: got.update({n: files.read_or_build(spark, path, lambda: build(n)).count()})) for n in (4, 6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert set(got) == {4, 6} and got[4] == got[6] in (4, 6)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert files.read_or_build(spark, path, lambda: spark.range(99)).count() == got[4]
