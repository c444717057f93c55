"""Ridge against its closed form; metrics and ensembles on hand-made predictions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from farelens.operators import models as ML


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 3))
    y = X @ np.array([3.0, -2.0, 0.5]) + 4.0 + rng.normal(scale=0.1, size=300)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(price=y)
    df = ML.assemble(spark.createDataFrame(pdf), ["a", "b", "c"])
    model = ML.train_ridge(df, alpha=10.0)
    # closed form with an unpenalised intercept: centre, solve, recover intercept
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 10.0 * np.eye(3), Xc.T @ yc)
    b = y.mean() - X.mean(0) @ w
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)
    assert abs(model.intercept - b) < 1e-6


def test_metrics_and_ensemble(spark):
    long = spark.createDataFrame([("k1", "m", 10.0, 8.0), ("k2", "m", 20.0, 22.0)],
                                 "fare_key string, model string, y double, prediction double")
    m = ML.regression_metrics(long).collect()[0]
    assert m.mae == 2.0 and m.mse == 4.0 and m.rmse == 2.0
    assert abs(m.r2 - (1 - 8.0 / 50.0)) < 1e-12 and abs(m.mape - 15.0) < 1e-12
    wide = spark.createDataFrame([(1.0, 2.0, 9.0)], "a double, b double, c double")
    r = wide.select(ML.ensemble(wide, ["a", "b", "c"], "average").alias("avg"),
                    ML.ensemble(wide, ["a", "b", "c"], "median").alias("med"),
                    ML.ensemble(wide, ["a", "b", "c"], "weighted", {"a": 1.0, "b": 1.0, "c": 1.0}).alias("w")).first()
    assert r.avg == 4.0 and r.med == 2.0 and abs(r.w - 4.0) < 1e-9
