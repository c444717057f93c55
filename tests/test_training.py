"""Boosting rounds, tuning, persistence and importances on a small table with signal."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from farelens.operators import boosting, models as ML
from farelens.operators.boosting import Binned


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(price=50 + 8 * x[:, 0] + 4 * np.sign(x[:, 1]) + rng.normal(size=n),
                                                       fare_key=[f"k{i}" for i in range(n)])
    df = ML.assemble(spark.createDataFrame(pdf), list("abcd")).cache()
    return df.where("fare_key < 'k6'").cache(), df.where("fare_key >= 'k6'").cache()


def test_best_round_waits_for_patience():
    assert ML.best_round([5, 4, 4.5, 3, 3.5, 3.6], patience=2) == 4
    assert ML.best_round([5, 4, 4.5, 4.6, 1], patience=2) == 2
    assert ML.best_round([5, 4, 3], patience=10) == 3
    assert ML.best_round([1], patience=10) == 1


def test_boosted_trees_keep_the_rounds_that_help(frames):
    train, val = frames
    model = ML.train_boosted(train, max_iter=30, max_depth=3, validation=val)
    rounds = ML.rounds_of(model)
    assert rounds["fitted"] == 30 and 1 < rounds["kept"] <= 30 and model.getNumTrees == rounds["kept"]
    assert ML.regression_metrics(ML.predict(model, val, "m")).first()["r2"] > 0.7


def test_depth_over_the_limit_is_an_error(frames):
    with pytest.raises(ValueError, match="max_depth"):
        ML.train_forest(frames[0], max_depth=31)


def test_grid_marks_one_best_point_and_refits_it(frames):
    train, val = frames
    table, best = ML.grid_tune(train, val, grid={"maxDepth": [1, 3], "maxIter": [3], "stepSize": [0.1, 0.3]}, parallelism=3)
    rows = table.collect()
    assert [r.grid_index for r in rows] == [0, 1, 2, 3] and sum(r.best for r in rows) == 1
    assert best["best_rmse"] == min(r.rmse for r in rows) and best["model"].getMaxDepth() == best["best_params"]["maxDepth"]


def test_grid_runs_as_many_fits_as_memory_holds(spark, frames, monkeypatch):
    train, val = (f.select("*") for f in frames)                    # not cached by the test itself
    n, per_row = train.count(), 4 * 4 + 250
    assert ML.fits_at_a_time(train, memory=3 * n * per_row) == 3 and ML.fits_at_a_time(train, memory=n) == 1
    assert ML.fits_at_a_time(train) > 4 and ML.fits_at_a_time(train.limit(0)) == 1
    pools, held, pool = [], [], ML.ThreadPool
    grid = {"maxDepth": [1, 2], "maxIter": [2], "stepSize": [0.1, 0.3]}
    several, _ = ML.grid_tune(train, val, grid=grid)
    monkeypatch.setattr(ML, "ThreadPool", lambda k: pools.append(k) or held.append((train.is_cached, val.is_cached)) or pool(k))
    monkeypatch.setattr(ML, "fits_at_a_time", lambda rows: 1)
    single, _ = ML.grid_tune(train, val, grid=grid)
    assert pools == [1] and held == [(False, False)]
    key = lambda r: (r.grid_index, r.params, r.best, round(r.rmse, 6))
    assert [*map(key, single.collect())] == [*map(key, several.collect())]


def test_saved_model_keeps_predictions_metrics_and_parameters(spark, frames, tmp_path):
    train, val = frames
    model = ML.train_ridge(train)
    metrics = ML.regression_metrics(ML.predict(model, val, "ridge"))
    ML.save_model(model, str(tmp_path), metrics, {"alpha": 1.0})
    back, params = ML.load_training(str(tmp_path))
    assert params == {"alpha": 1.0} and back.collect() == metrics.collect()
    a = ML.predict(model, val, "m").orderBy("fare_key").collect()
    assert a == ML.predict(ML.load_model(str(tmp_path)), val, "m").orderBy("fare_key").collect()


def test_training_all_reports_errors(frames):
    train, val = frames
    models, metrics, errors = ML.train_all(train, val, params={"random_forest": {"max_depth": 99},
                                                               "boosted_trees": {"max_iter": 2, "max_depth": 2}})
    assert set(models) == {"linear_regression", "boosted_trees"} and set(errors) == {"random_forest"}
    assert metrics.count() == 4
    with pytest.raises(RuntimeError, match="no model"):
        ML.train_all(train.drop("features"), val.drop("features"))


def test_importances_and_components(frames):
    train, _ = frames
    top = ML.top_features(ML.train_forest(train, num_trees=5, max_depth=4), list("abcd"), 2).collect()
    assert top[0].feature == "a" and top[0].importance >= top[1].importance
    _, out = ML.pca_reduce(train, k=2)
    m = np.array([r.pca_features.toArray() for r in out.select("pca_features").collect()])
    assert m.shape[1] == 2 and abs(np.corrcoef(m.T)[0, 1]) < 1e-6


def test_boosted_trees_equal_the_library_s(frames):
    train, val = frames
    sizes = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3}
    rows = Binned(train, "price")
    grown = rows.fit([sizes, {**sizes, "maxDepth": 2}])
    mine = [rows.to_model(trees, fit) for trees, fit in zip(grown, (sizes, {**sizes, "maxDepth": 2}))]
    losses = rows.losses(val, [sizes], grown[:1])[0]
    rows.close()
    for model, depth in zip(mine, (4, 2)):
        theirs = ML.GBTRegressor(labelCol="price", **{**sizes, "maxDepth": depth}).fit(train)
        # splits that part the rows alike have equal gains, and either may be taken
        assert np.allclose(model.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.01)
        assert model.getMaxDepth() == depth and list(model.treeWeights) == list(theirs.treeWeights)
        a, b = ([r.prediction for r in m.transform(train).orderBy("fare_key").collect()] for m in (model, theirs))
        assert np.allclose(a, b)
    assert np.allclose(losses, mine[0].evaluateEachIteration(val, "squared"))


def test_boosted_trees_sum_no_row_twice(spark, frames, monkeypatch):
    """A level is one job over the binned rows that sums one child of each pair only; the library sums every row on every level."""
    train, _ = frames
    seen, sums = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda state, pieces, key, live: seen.append(
        (len(pieces), [p[3].max() + 1 for p in pieces])) or sums(state, pieces, key, live))
    ML.train_boosted(train, max_iter=2, max_depth=3, subsample=1.0, col_sample=1.0)
    assert [k for _, (k,) in seen] == [1, 1, 2] * 2
    seen.clear()
    ML.grid_tune(train, train, grid={"maxDepth": [2], "maxIter": [2], "stepSize": [0.1, 0.2, 0.3]}, parallelism=1)
    assert [n for n, _ in seen] == [3] * 4                            # the three fits share every job


def test_results_over_the_limit_come_in_several_jobs(frames, monkeypatch):
    train, val = frames
    whole = ML.train_boosted(train, max_iter=3, max_depth=4)
    monkeypatch.setattr(boosting, "RESULT_BYTES", 1)
    pieces = ML.train_boosted(train, max_iter=3, max_depth=4)
    key = lambda m: [r.prediction for r in m.transform(val).orderBy("fare_key").collect()]
    assert np.allclose(key(whole), key(pieces), rtol=1e-12)


def test_labels_must_be_numbers_and_constant_columns_do_not_split(spark, frames):
    train, _ = frames
    with pytest.raises(ValueError, match="labels"):
        ML.train_boosted(train.withColumn("price", F.when(F.col("a") < 0, F.col("price"))), max_iter=1)
    flat = ML.assemble(spark.createDataFrame([(1.0, float(i)) for i in range(8)], "x double, price double"), ["x"])
    model = ML.train_boosted(flat, max_iter=2, max_depth=2, subsample=1.0)
    assert {r.prediction for r in model.transform(flat).collect()} == {3.5}


def test_the_registered_grid_is_the_whole_default_grid():
    from farelens.plans import q_models
    sizes = {k: len(v) for k, v in q_models.GRID.items()}
    assert q_models.GRID is ML.DEFAULT_GRID and sizes == dict.fromkeys(["maxDepth", "stepSize", "maxIter", "subsamplingRate", "featureSubsetStrategy"], 3)
    assert q_models._grid_rows().count("SELECT") == 243
