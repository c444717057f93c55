"""Model queries: metrics, comparison, ensembles and residuals over fixed predictions, and distributed
training, tuning, importances and persistence (checked by statements that must hold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from farelens.operators import analytics as A
from farelens.operators import booking as B
from farelens.operators import encode as M
from farelens.operators import models as ML
from farelens.plans.oracle import with_ctes
from farelens.plans.q_matrix import MATRIX, fitted
from farelens.plans.registry import query
from farelens.sources import tables
from farelens.operators.stats import materialize
from farelens.session import scratch_path

MODELS = ["linear_regression", "random_forest", "boosted_trees"]
PRED_COLS = {"linear_regression": "pred_linear", "random_forest": "pred_forest", "boosted_trees": "pred_boosted"}


def quotes_long(quotes: DataFrame) -> DataFrame:
    q = M.split_rows(quotes)
    preds = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction")) for m, c in PRED_COLS.items()])
    return q.select("fare_key", "split", "y", F.explode(preds).alias("p")).select(
        "fare_key", "split", "p.model", "y", "p.prediction")


def metrics(spark, d) -> DataFrame:
    return ML.regression_metrics(quotes_long(tables.quotes(spark, d)))


def _rounded(m: DataFrame) -> DataFrame:
    return m.select("model", "split", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"),
                    F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


@query("regression_metrics", with_ctes("""
SELECT model, split, round(mae, 4) AS mae, round(mse, 2) AS mse, round(rmse, 4) AS rmse, round(r2, 6) AS r2,
       round(mape, 6) AS mape FROM metrics""", "metrics"))
def regression_metrics(spark, d):
    return _rounded(metrics(spark, d))


@query("compare_models", with_ctes("""
SELECT model, round(mae, 4) AS mae, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(r2, 4) AS r2,
       round(mape, 4) AS mape FROM metrics WHERE split = 'val' ORDER BY rmse""", "metrics"))
def compare_models(spark, d):
    return ML.compare_models(metrics(spark, d))


@query("best_model", with_ctes("""
SELECT model, round(rmse, 4) AS rmse FROM metrics WHERE split = 'val' ORDER BY rmse, model LIMIT 1""", "metrics"))
def best_model(spark, d):
    return ML.best_model(metrics(spark, d)).select("model", F.round("rmse", 4).alias("rmse"))


def _val_rmse(quotes: DataFrame) -> dict:
    rows = ML.regression_metrics(quotes_long(quotes)).where(F.col("split") == "val").select("model", "rmse").collect()
    return {PRED_COLS[r["model"]]: r["rmse"] for r in rows}


_W = "(1.0 / (rmse + 1e-8))"


@query("ensemble", with_ctes(f"""
SELECT q.fare_key, round((pred_linear + pred_forest + pred_boosted) / 3.0, 4) AS ensemble_average,
       round(0.0 + pred_linear * (w.wl / w.t) + pred_forest * (w.wf / w.t) + pred_boosted * (w.wb / w.t), 4)
         AS ensemble_weighted,
       round(list_sort([pred_linear, pred_forest, pred_boosted])[2], 4) AS ensemble_median
FROM quotes q, (SELECT max(CASE WHEN model = 'linear_regression' THEN {_W} END) AS wl,
                       max(CASE WHEN model = 'random_forest' THEN {_W} END) AS wf,
                       max(CASE WHEN model = 'boosted_trees' THEN {_W} END) AS wb,
                       sum({_W}) AS t FROM metrics WHERE split = 'val') w""", "metrics"))
def ensemble(spark, d):
    cols = list(PRED_COLS.values())
    q = materialize(tables.quotes(spark, d).select("fare_key", "y", *cols), "quotes")
    w = _val_rmse(q)
    return q.select("fare_key",
                    F.round(ML.ensemble(q, cols, "average"), 4).alias("ensemble_average"),
                    F.round(ML.ensemble(q, cols, "weighted", w), 4).alias("ensemble_weighted"),
                    F.round(ML.ensemble(q, cols, "median"), 4).alias("ensemble_median"))


@query("residuals", with_ctes("""
SELECT fare_key, split, model, y AS actual, prediction AS predicted, y - prediction AS residual FROM qlong""", "qlong"))
def residuals(spark, d):
    return ML.residuals(quotes_long(tables.quotes(spark, d)))


QUOTE_SQL = with_ctes("""
SELECT fare_key, pred_linear, pred_forest, pred_boosted, m AS ensemble_mean,
       least(pred_linear, pred_forest, pred_boosted) AS ensemble_min,
       greatest(pred_linear, pred_forest, pred_boosted) AS ensemble_max,
       (greatest(pred_linear, pred_forest, pred_boosted) - least(pred_linear, pred_forest, pred_boosted)) / 2.0
         AS uncertainty,
       conf AS confidence,
       CASE WHEN conf > 0.8 THEN 'High' WHEN conf > 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_level,
       CASE WHEN conf > 0.8 THEN 'High confidence prediction. Expected price: ₹' || format('{:,.0f}', round(m, 0))
            WHEN conf > 0.6 THEN 'Moderate confidence. Price estimate: ₹' || format('{:,.0f}', round(m, 0)) || ' (±10%)'
            ELSE 'Low confidence. Price range: ₹' || format('{:,.0f}', round(m * 0.85, 0)) || ' - ₹'
                 || format('{:,.0f}', round(m * 1.15, 0)) END AS advice
FROM (SELECT *, least(1.0, greatest(0.0, 1.0 - sqrt(v) / m)) AS conf FROM (
  SELECT *, ((pred_linear - m) * (pred_linear - m) + (pred_forest - m) * (pred_forest - m)
             + (pred_boosted - m) * (pred_boosted - m)) / 3.0 AS v
  FROM (SELECT fare_key, pred_linear, pred_forest, pred_boosted, (pred_linear + pred_forest + pred_boosted) / 3.0 AS m
        FROM quotes)))""", "quotes")


def _quote(spark, d) -> DataFrame:
    q = tables.quotes(spark, d).select("fare_key", *PRED_COLS.values())
    return B.multi_model_quote(q, list(PRED_COLS.values()))


@query("multi_model_quote", QUOTE_SQL)
def multi_model_quote(spark, d):
    return _quote(spark, d)


@query("ensemble_summary", with_ctes(
    "SELECT fare_key, ensemble_mean, ensemble_min, ensemble_max, uncertainty FROM (" + QUOTE_SQL + ")", "quotes"))
def ensemble_summary(spark, d):
    q = tables.quotes(spark, d).select("fare_key", *PRED_COLS.values())
    return A.ensemble_summary(q, list(PRED_COLS.values())).select(
        "fare_key", "ensemble_mean", "ensemble_min", "ensemble_max", "uncertainty")


@query("model_spread_confidence", with_ctes(
    "SELECT fare_key, confidence, confidence_level FROM (" + QUOTE_SQL + ")", "quotes"))
def model_spread_confidence(spark, d):
    return _quote(spark, d).select("fare_key", "confidence", "confidence_level")


@query("price_advice_text", with_ctes("SELECT fare_key, advice FROM (" + QUOTE_SQL + ")", "quotes"))
def price_advice_text(spark, d):
    return _quote(spark, d).select("fare_key", "advice")


# ---------------------------------------------------------------- training
# The queries train at the library's default sizes (100 trees of depth 20, 100 boosting rounds of
# depth 6) on a label that the features can explain (``fare_value``, as ``price`` of the training
# table). A fit has no SQL twin, so each query returns statements about it that must hold: keys
# and labels from SQL, optimality conditions, ranges, counts.
LABEL = "fare_value"
GRID = ML.DEFAULT_GRID


def _all_true(names) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", TRUE AS ok" for n in names)


def _statements(spark, checks: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in checks.items()], "check string, ok boolean")


_kept: dict[tuple, object] = {}


def once(spark, key: tuple, build):
    """What ``build`` makes, once per application: the training queries share their written table and their fits."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0]]:
            del _kept[old]
        _kept[key] = build()
    return _kept[key]


def training_set(spark, d) -> dict:
    """Scaled feature matrix with a stable split, assembled and written for the fits (one pass over the fares), and its fitted state."""
    def build():
        feats, state = fitted(spark, d, (LABEL,))
        x = M.split_rows(M.transform_matrix(feats, state, keep=("fare_key", LABEL)).withColumnRenamed(LABEL, "price"))
        data = materialize(ML.assemble(x, state["feature_columns"]).select("fare_key", "price", "split", "features"), "training")
        return {"data": data, "features": feats, "state": state}
    return once(spark, ("training", d), build)


def training_frames(spark, d):
    """(train, val, test, feature columns) of ``training_set``."""
    t = training_set(spark, d)
    train, val, test = (t["data"].where(F.col("split") == s) for s in ("train", "val", "test"))
    return train, val, test, t["state"]["feature_columns"]


def trained(spark, d, name: str):
    """A model of the default size, fitted once per application (as it is, or as ``train_all`` left it)."""
    def build():
        train, val, _, _ = training_frames(spark, d)
        return ML.train_boosted(train, validation=val) if name == "boosted_trees" else ML.TRAINERS[name](train)
    return once(spark, ("model", d, name), build)


def _normal_equations(train: DataFrame, model, feats: list[str], alpha: float) -> DataFrame:
    """Per feature: does ``sum(x * (prediction - y)) + alpha * w`` vanish, against the size of its terms?"""
    from pyspark.ml.functions import vector_to_array
    err = F.col("prediction") - F.col("price")
    x = model.transform(train).select(vector_to_array("features").alias("x"), err.alias("e"), "price")
    sums = x.agg(*[F.sum(F.col("x")[i] * F.col("e")).alias(f"g{i}") for i in range(len(feats))],
                 *[F.sum(F.abs(F.col("x")[i] * F.col("price"))).alias(f"s{i}") for i in range(len(feats))],
                 F.sum("e").alias("total"), F.sum("price").alias("size")).first()
    w = model.coefficients.toArray().tolist()
    checks = {c: abs(sums[f"g{i}"] + alpha * w[i]) <= 1e-6 * max(sums[f"s{i}"], 1.0) for i, c in enumerate(feats)}
    checks["(intercept)"] = abs(sums["total"]) <= 1e-6 * sums["size"]
    return _statements(train.sparkSession, checks)


@query("ridge", _all_true([*MATRIX, "(intercept)"]))
def ridge(spark, d):
    train, _, _, feats = training_frames(spark, d)
    return _normal_equations(train, trained(spark, d, "linear_regression"), feats, 1.0)


def _tree_checks(model, train, val, name: str) -> dict[str, bool]:
    """Statements on the predictions of the validation rows, scored once."""
    lo, hi = train.agg(F.min("price"), F.max("price")).first()
    err = F.col("y") - F.col("prediction")
    seen = ML.predict(model, val, name).agg(
        F.min("prediction").alias("lo"), F.max("prediction").alias("hi"), F.count("prediction").alias("n"), F.count(F.lit(1)).alias("rows"),
        (F.lit(1.0) - F.sum(err * err) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2")).first()
    slack = 0.5 * (hi - lo) if name == "boosted_trees" else 1e-6 * (hi - lo)      # sums of trees may overshoot
    return {"every row scored": seen["n"] == seen["rows"], "inside the training range": lo - slack <= seen["lo"] and seen["hi"] <= hi + slack,
            "explains the label": seen["r2"] > 0.1}


@query("random_forest", _all_true(["tree count", "depth", "every row scored", "inside the training range", "explains the label"]))
def random_forest(spark, d):
    train, val, _, _ = training_frames(spark, d)
    model = trained(spark, d, "random_forest")
    return _statements(spark, {"tree count": model.getNumTrees == 100, "depth": model.getMaxDepth() == 20,
                               **_tree_checks(model, train, val, "random_forest")})


@query("boosted_trees", _all_true(["rounds fitted", "rounds kept", "tree count", "every row scored", "inside the training range",
                                   "explains the label"]))
def boosted_trees(spark, d):
    train, val, _, _ = training_frames(spark, d)
    model = trained(spark, d, "boosted_trees")
    rounds = ML.rounds_of(model)
    return _statements(spark, {"rounds fitted": rounds["fitted"] == 100, "rounds kept": rounds["kept"] > 1,
                               "tree count": model.getNumTrees == rounds["kept"],
                               **_tree_checks(model, train, val, "boosted_trees")})


_TEST_ROWS = """SELECT fare_key, y FROM (SELECT fare_key, y,
  CAST(('0x' || substr(md5(fare_key), 1, 8)) AS BIGINT) % 100 AS b FROM quotes) WHERE b >= 80"""


@query("predict", with_ctes(f"SELECT fare_key, 'linear_regression' AS model, y, TRUE AS as_coefficients FROM ({_TEST_ROWS})", "quotes"))
def predict(spark, d):
    """Predictions of the test rows, compared with the model's coefficients applied by hand."""
    from pyspark.ml.functions import vector_to_array
    train, _, test, _ = training_frames(spark, d)
    model = trained(spark, d, "linear_regression")
    w = F.array(*[F.lit(float(v)) for v in model.coefficients.toArray()])
    by_hand = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda x, c: x * c), F.lit(float(model.intercept)),
                          lambda a, v: a + v)
    hand = test.select("fare_key", by_hand.alias("hand"))
    out = ML.predict(model, test, "linear_regression").join(hand, "fare_key")
    return out.select("fare_key", "model", "y", (F.abs(F.col("prediction") - F.col("hand")) < 1e-6).alias("as_coefficients"))


_TRAINED = (" UNION ALL ".join(f"SELECT '{m}' AS model, '{s}' AS split, TRUE AS explains, '' AS error" for m in MODELS for s in ("train", "val"))
            + " UNION ALL SELECT 'stopped_model', NULL, FALSE, 'ValueError: max_depth must lie between 0 and 30'")


@query("train_all", _TRAINED)
def train_all(spark, d):
    """All models at once in pools of their own; a fourth one that cannot be trained becomes a row with its error."""
    train, val, _, _ = training_frames(spark, d)
    known = {name: _kept[k] for name in MODELS if (k := (spark.sparkContext.applicationId, "model", d, name)) in _kept}
    trainers = {**ML.TRAINERS, "stopped_model": ML.train_forest}
    models, m, errors = ML.train_all(train, val, trainers=trainers, fitted=known, params={
        "boosted_trees": {"use_validation": True}, "stopped_model": {"max_depth": 31}})
    for name, model in models.items():
        once(spark, ("model", d, name), lambda model=model: model)
    report = ML.training_report(m, errors)
    return report.select("model", "split", F.coalesce(F.col("r2") > 0.1, F.lit(False)).alias("explains"), F.coalesce("error", F.lit("")).alias("error"))


def _grid_rows() -> str:
    import itertools
    import json
    points = [dict(zip(GRID, v)) for v in itertools.product(*GRID.values())]
    rows = [f"SELECT '{json.dumps(p, sort_keys=True)}' AS params, TRUE AS scored, 1 AS n_best" for p in points]
    return " UNION ALL ".join(rows)


@query("grid_tune", _grid_rows())
def grid_tune(spark, d):
    """M11 on the library's default grid: 243 points from 81 fits of 200 rounds."""
    train, val, _, _ = training_frames(spark, d)
    table, _ = ML.grid_tune(train, val, grid=GRID)
    n_best = F.sum(F.col("best").cast("int")).over(Window.partitionBy(F.lit(1)))      # as many rows as grid points
    return table.select("params", (F.col("rmse") > 0).alias("scored"), n_best.cast("int").alias("n_best"))


@query("top_features", _all_true(["all importances", "sum", "fifteen rows", "falling", "known features"]))
def top_features(spark, d):
    _, _, _, feats = training_frames(spark, d)
    model = trained(spark, d, "random_forest")
    every = {r["feature"]: r["importance"] for r in ML.top_features(model, feats, len(feats)).collect()}
    top = ML.top_features(model, feats, 15).collect()
    values = [r["importance"] for r in top]
    return _statements(spark, {"all importances": set(every) == set(feats) and min(every.values()) >= 0,
                               "sum": abs(sum(every.values()) - 1) < 1e-9, "fifteen rows": len(top) == 15,
                               "falling": values == sorted(values, reverse=True),
                               "known features": all(every[r["feature"]] == r["importance"] for r in top)})


@query("pca_reduce", _all_true(["components", "uncorrelated", "falling variances"]))
def pca_reduce(spark, d):
    from pyspark.ml.functions import vector_to_array
    train, _, _, _ = training_frames(spark, d)
    _, out = ML.pca_reduce(train, k=4)
    c = out.select(vector_to_array("pca_features").alias("c"))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    r = c.agg(*[F.var_pop(F.col("c")[i]).alias(f"v{i}") for i in range(4)], F.max(F.size("c")).alias("k"),
              *[F.corr(F.col("c")[i], F.col("c")[j]).alias(f"r{i}{j}") for i, j in pairs]).first()
    v = [r[f"v{i}"] for i in range(4)]
    return _statements(spark, {"components": r["k"] == 4, "falling variances": v == sorted(v, reverse=True) and v[-1] > 0,
                               "uncorrelated": max(abs(r[f"r{i}{j}"]) for i, j in pairs) < 1e-6})


PHASE_NAMES = ([f"amp_{f}_{i}" for i in range(4) for f in ("sin", "cos")]
               + [f"ent_{f}_{i}_{j}" for i in range(2) for j in range(i + 1, 4) for f in ("prod", "sc")]
               + [f"phase_{f}_{i}" for i in range(3) for f in ("sin", "cos")])


@query("phase_regression", _all_true([*PHASE_NAMES, "(intercept)"]))
def phase_regression(spark, d):
    """The phase features of the first four scaled columns, regressed with ridge."""
    feats, state = fitted(spark, d, (LABEL,))
    x = materialize(M.split_rows(M.transform_matrix(feats, state, keep=("fare_key", LABEL))).withColumnRenamed(LABEL, "price")
                    .select("fare_key", "price", "split", *state["feature_columns"][:4]), "phase-input")
    ph = M.phase_features(x, state["feature_columns"][:4], keep=("fare_key", "price", "split"))
    names = [c for c in ph.columns if c not in ("fare_key", "price", "split")]
    train = materialize(ML.assemble(ph, names).where("split = 'train'").select("fare_key", "price", "features"), "phase-training")
    return _normal_equations(train, ML.train_ridge(train, alpha=1.0), names, 1.0)


@query("save_load_model", with_ctes(f"SELECT fare_key, y, TRUE AS same FROM ({_TEST_ROWS})", "quotes"))
def save_load_model(spark, d):
    """Save a fitted model with metrics and parameters, load it back, score the test rows with both."""
    train, val, test, _ = training_frames(spark, d)
    model = ML.train_ridge(train, alpha=1.0)
    path = scratch_path(spark, "model-ridge")
    metrics = materialize(ML.regression_metrics(ML.predict(model, val, "linear_regression")), "ridge-metrics")
    ML.save_model(model, path, metrics, {"alpha": 1.0, "model": "linear_regression"})
    saved, params = ML.load_training(path)
    if params != {"alpha": 1.0, "model": "linear_regression"} or saved.first()["rmse"] != metrics.first()["rmse"]:
        raise RuntimeError("metrics or parameters changed on the way")
    before = ML.predict(model, test, "saved").select("fare_key", "y", F.col("prediction").alias("p"))
    after = ML.predict(ML.load_model(path), test, "loaded").select("fare_key", F.col("prediction").alias("q"))
    return before.join(after, "fare_key").select("fare_key", "y", (F.col("p") == F.col("q")).alias("same"))
