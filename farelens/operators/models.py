"""Distributed regressors, evaluation, comparison and ensembles.

Models are ``pyspark.ml`` estimators trained on the cached, scaled feature
matrix; predictions, metrics and ensembles are DataFrames:

* predictions in *long* form ``(key, model, y, prediction)`` so one grouped
  aggregate evaluates every model on every split;
* metrics ``(model, split, mae, mse, rmse, r2, mape)``;
* ensembles as column expressions over one column per model.
"""

from __future__ import annotations

import json
import time
from importlib import import_module
from multiprocessing.pool import ThreadPool
from statistics import median_low

from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelens.operators.boosting import DEFAULTS as FIT_PARAMS, Binned

LOWER_IS_BETTER = ("rmse", "mae", "mse", "mape")
DEFAULT_GRID = {"maxDepth": [3, 6, 9], "stepSize": [0.01, 0.1, 0.2], "maxIter": [50, 100, 200],
                "subsamplingRate": [0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.8", "0.9", "1.0"]}


def assemble(df: DataFrame, feature_cols: list[str], out: str = "features") -> DataFrame:
    """Feature columns -> one vector column (nulls are an error: fill them first, M3)."""
    return VectorAssembler(inputCols=feature_cols, outputCol=out, handleInvalid="error").transform(df)


# ---------------------------------------------------------------- M7-M9
def train_ridge(train: DataFrame, label: str = "price", alpha: float = 1.0, features: str = "features"):
    """M7: L2 least squares equal to ``||y - Xw - b||^2 + alpha ||w||^2``, solved from the normal equations.

    Spark's objective is ``1/(2n) ||.||^2 + regParam/2 ||w||^2`` with the label
    scaled by its deviation, so ``regParam = alpha / n * std_pop(y)``. A constant column has weight 0 and
    would make Spark's scaled equations singular (it then iterates and may give up), so the fit leaves
    such columns out and the model gets a 0 in their place.
    """
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd"),
                  Summarizer.metrics("min", "max").summary(F.col(features)).alias("x")).first()
    reg = alpha / r["n"] * (r["sd"] or 1.0)
    low, high = r["x"]["min"].toArray(), r["x"]["max"].toArray()
    varies = [i for i in range(len(low)) if low[i] < high[i]]
    lr = LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, regParam=reg,
                          standardization=False, solver="normal", fitIntercept=True, tol=1e-14, maxIter=2000)
    if len(varies) == len(low) or not varies:
        return lr.fit(train)
    part = VectorSlicer(inputCol=features, outputCol="_varying", indices=varies).transform(train.select(features, label))
    fitted = lr.copy({lr.featuresCol: "_varying"}).fit(part)
    weights = [0.0] * len(low)
    for i, w in zip(varies, fitted.coefficients.toArray().tolist()):
        weights[i] = w
    jvm = SparkSession.active().sparkContext._jvm
    vector = jvm.org.apache.spark.ml.linalg.DenseVector(_java_doubles(weights))
    model = LinearRegressionModel(jvm.org.apache.spark.ml.regression.LinearRegressionModel(fitted.uid, vector, float(fitted.intercept)))
    known = {p.name for p in model.params}
    model._set(**{p.name: v for p, v in lr.extractParamMap().items() if p.name in known})
    model._transfer_params_to_java()
    return model


def _java_doubles(values):
    sc = SparkSession.active().sparkContext
    out = sc._gateway.new_array(sc._jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def train_forest(train: DataFrame, label: str = "price", num_trees: int = 100, max_depth: int = 20,
                 min_instances: int = 1, seed: int = 42, features: str = "features"):
    """M8: random forest regressor; Spark grows trees of depth 30 at most.

    Deep levels are split in few passes (``maxMemoryInMB``) over cached node numbers
    (``cacheNodeIds``), whose lineage is cut every ten levels.
    """
    if not 0 <= max_depth <= 30:
        raise ValueError("max_depth must lie between 0 and 30")
    rf = RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees,
                               maxDepth=max_depth, minInstancesPerNode=min_instances, seed=seed,
                               subsamplingRate=1.0, featureSubsetStrategy="onethird", maxMemoryInMB=1024,
                               cacheNodeIds=True, checkpointInterval=10)
    return rf.fit(train)


def train_boosted(train: DataFrame, label: str = "price", max_iter: int = 100, max_depth: int = 6,
                  step_size: float = 0.1, subsample: float = 0.8, col_sample: float = 0.8,
                  validation: DataFrame | None = None, seed: int = 42, features: str = "features",
                  patience: int = 10):
    """M9: gradient-boosted trees, grown from histograms of the binned rows (``boosting``).

    With ``validation`` rows every round is scored on them, and the rounds up to the best one are
    kept: the search for it ends after ``patience`` rounds without improvement. ``rounds_of``
    tells the rounds fitted and kept.
    """
    fit = {"maxIter": max_iter, "maxDepth": max_depth, "stepSize": step_size, "subsamplingRate": subsample,
           "featureSubsetStrategy": str(col_sample)}
    rows = Binned(train, label, features, seed)
    try:
        trees, kept = rows.fit([fit], seed)[0], max_iter
        if validation is not None:
            kept = best_round(rows.losses(validation, [fit], [trees])[0], patience)
        model = rows.to_model(trees[:kept], fit, seed)
    finally:
        rows.close()
    model.rounds = {"fitted": max_iter, "kept": kept}
    return model


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first ``rounds`` of a boosted fit: what a shorter fit with the same seed gives."""
    if not 1 <= rounds <= model.getNumTrees:
        raise ValueError(f"rounds must lie between 1 and {model.getNumTrees}")
    if rounds == model.getNumTrees:
        return model
    sc = SparkSession.active().sparkContext
    java = model._java_obj
    kind = sc._jvm.org.apache.spark.ml.regression
    trees = sc._gateway.new_array(kind.DecisionTreeRegressionModel, rounds)
    held, weights = java.trees(), _java_doubles(list(java.treeWeights())[:rounds])
    for i in range(rounds):
        trees[i] = held[i]
    out = GBTRegressionModel(kind.GBTRegressionModel(f"{model.uid}_{rounds}", trees, weights, java.numFeatures()))
    known = {p.name for p in out.params}
    for p, v in model.extractParamMap().items():
        if p.name in known and p.name != "maxIter":
            out._set(**{p.name: v})
    out._set(maxIter=rounds)
    out._transfer_params_to_java()
    return out


def best_round(losses: list[float], patience: int = 10) -> int:
    """Number of rounds up to the smallest loss met before ``patience`` rounds without a smaller one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def rounds_of(model) -> dict:
    """Boosting rounds fitted and kept (of a loaded model: as kept)."""
    return getattr(model, "rounds", {"fitted": model.getNumTrees, "kept": model.getNumTrees})


TRAINERS = {"linear_regression": train_ridge, "random_forest": train_forest, "boosted_trees": train_boosted}


# ---------------------------------------------------------------- M10, M16
def predict(model, df: DataFrame, name: str, key: str = "fare_key", label: str = "price") -> DataFrame:
    """Long-form predictions ``(key, model, y, prediction)``."""
    if model is None:
        raise ValueError(f"no fitted model for {name}")
    out = model.transform(df)
    keep = [c for c in (key, "split") if c in out.columns]
    return out.select(*keep, F.lit(name).alias("model"), F.col(label).alias("y"), F.col("prediction"))


def residuals(long_preds: DataFrame) -> DataFrame:
    """Actual, predicted and residual per row and model."""
    return long_preds.select(*[c for c in long_preds.columns if c not in ("y", "prediction")],
                             F.col("y").alias("actual"), F.col("prediction").alias("predicted"),
                             (F.col("y") - F.col("prediction")).alias("residual"))


# ---------------------------------------------------------------- A15
def regression_metrics(long_preds: DataFrame, by=("model", "split")) -> DataFrame:
    """Mae, mse, rmse, r2 (1 - SSE/SST) and mape (percent) per group, in one aggregate."""
    err = F.col("y") - F.col("prediction")
    g = long_preds.groupBy(*[b for b in by if b in long_preds.columns]).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        F.sum(err * err).alias("_sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("_sst"),
        (F.avg(F.abs(err / F.col("y"))) * 100).alias("mape"))
    return g.select(*[b for b in by if b in long_preds.columns], "mae", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.col("_sse") / F.col("_sst")).alias("r2"), "mape")


# ---------------------------------------------------------------- K6, K7
def best_model(metrics: DataFrame, metric: str = "rmse", split: str = "val") -> DataFrame:
    """K6: the model with the lowest error metric (or highest r2) on ``split``."""
    m = metrics.where(F.col("split") == split) if "split" in metrics.columns else metrics
    order = F.col(metric).asc() if metric in LOWER_IS_BETTER else F.col(metric).desc()
    return m.orderBy(order, F.col("model")).limit(1).select("model", metric)


def compare_models(metrics: DataFrame, split: str = "val", digits: int = 4) -> DataFrame:
    """K7: metric table rounded, in ascending rmse order."""
    m = metrics.where(F.col("split") == split) if "split" in metrics.columns else metrics
    cols = ["mae", "mse", "rmse", "r2", "mape"]
    return m.select("model", *[F.round(c, digits).alias(c) for c in cols]).orderBy("rmse")


# ---------------------------------------------------------------- M13
def ensemble(wide: DataFrame, pred_cols: list[str], method: str = "average",
             weights: dict[str, float] | None = None) -> Column:
    """Row mean, inverse-rmse weighted mean, or median of the model columns."""
    cols = [F.col(c) for c in pred_cols]
    if method == "average":
        return sum(cols[1:], cols[0]) / F.lit(float(len(cols)))
    if method == "weighted":
        if not weights:
            raise ValueError("weighted ensemble needs rmse per model")
        inv = {c: 1.0 / (weights[c] + 1e-8) for c in pred_cols}
        total = sum(inv.values())
        out = F.lit(0.0)
        for c in pred_cols:
            out = out + F.col(c) * F.lit(inv[c] / total)
        return out
    srt = F.array_sort(F.array(*cols))
    n = len(cols)
    if n % 2:
        return srt[n // 2]
    return (srt[n // 2 - 1] + srt[n // 2]) / F.lit(2.0)


def wide_predictions(long_preds: DataFrame, models: list[str], key: str = "fare_key") -> DataFrame:
    """Long predictions -> one column per model (a grouped pivot over a known model list)."""
    return long_preds.groupBy(key).pivot("model", models).agg(F.first("prediction"))


# ---------------------------------------------------------------- M11, M12
def fits_at_a_time(rows: DataFrame, features: str = "features", memory: float | None = None) -> int:
    """How many boosted fits over ``rows`` hold their rows in the executors' memory together, one at least.

    A fit is counted with four bytes per feature and 250 more a row, far above what it stores (a byte per feature and its predictions
    of two rounds), as the tasks hold blocks and sums beside it. More fits than fit would read their rows from disk on every level. ``memory``:
    bytes to share, by default four fifths of what the executors have for stored blocks.
    """
    if memory is None:
        status = SparkSession.active().sparkContext._jsc.sc().getExecutorMemoryStatus().values().toList()
        each = [status.apply(i)._1() for i in range(status.size())]
        memory = 0.8 * median_low(each) * max(len(each) - 1, 1)    # the driver is one of several
    first = rows.select(features).first()
    if first is None:
        return 1
    return max(1, int(memory // max(rows.count() * (4 * first[0].size + 250), 1)))


def grid_tune(train: DataFrame, val: DataFrame, label: str = "price", grid: dict | None = None,
              parallelism: int = 4, seed: int = 42) -> tuple[DataFrame, dict]:
    """Every grid point of boosted trees fitted on train, scored on val; all results returned.

    Points that differ in ``maxIter`` only share one fit: the longest of them holds the others as its
    first rounds, and its validation error after each round answers all of them. The rows are binned once. The fits
    are dealt to ``parallelism`` threads at most; those of a thread grow side by side and share every job, as many as leave
    room for all in the executors' memory (``fits_at_a_time``). The winner is cut from its fit and returned. Ties go to the earlier point.
    """
    grid = grid or DEFAULT_GRID
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed)
    builder = ParamGridBuilder()
    for k, vals in grid.items():
        builder = builder.addGrid(gbt.getParam(k), vals)
    points = [{p.name: v for p, v in m.items()} for m in builder.build()]
    if unknown := set(points[0]) - set(FIT_PARAMS):
        raise ValueError(f"parameters that the fits do not have: {sorted(unknown)}")
    rounds = [p.get("maxIter", gbt.getMaxIter()) for p in points]
    # points that differ in their number of rounds only are prefixes of the longest of them
    families: dict[str, list[int]] = {}
    for i, p in enumerate(points):
        families.setdefault(json.dumps({k: v for k, v in p.items() if k != "maxIter"}, sort_keys=True), []).append(i)
    members = list(families.values())
    fits = [points[max(own, key=lambda i: rounds[i])] for own in members]
    room = fits_at_a_time(train)
    parallelism = min(parallelism, len(fits), room)
    together = max(1, min(-(-len(fits) // parallelism), room // parallelism))
    rows = Binned(train, label, seed=seed)
    grown: dict[int, list] = {}

    def some(first: int) -> list[tuple[int, float]]:
        own = range(first, min(first + together, len(fits)))
        trees = rows.fit([fits[f] for f in own], seed)
        grown.update(zip(own, trees))
        losses = rows.losses(val, [fits[f] for f in own], trees)
        return [(i, each[rounds[i] - 1] ** 0.5) for f, each in zip(own, losses) for i in members[f]]

    try:
        with ThreadPool(parallelism) as pool:
            results = sorted(r for part in pool.imap_unordered(some, range(0, len(fits), together)) for r in part)
        idx, rmse = min(results, key=lambda r: (r[1], r[0]))
        at = next(a for a, own in enumerate(members) if idx in own)
        model = rows.to_model(grown[at][:rounds[idx]], {**fits[at], **points[idx]}, seed)
    finally:
        rows.close()
    table = train.sparkSession.createDataFrame([(i, e, json.dumps(points[i], sort_keys=True), i == idx) for i, e in results],
                                               "grid_index int, rmse double, params string, best boolean")
    return table, {"best_params": points[idx], "best_rmse": rmse, "model": model}


def train_all(train: DataFrame, val: DataFrame, label: str = "price", params: dict | None = None,
              key: str = "fare_key", trainers: dict | None = None, fitted: dict | None = None,
              timeout: float | None = None) -> tuple[dict, DataFrame, dict]:
    """Fit every model at the same time; train and val metrics; errors recorded per model instead of raised.

    Every fit runs in a thread of its own with a scheduler pool and a job group named after the model:
    under ``spark.scheduler.mode=FAIR`` the fits share the cluster evenly, otherwise the later ones fill
    what the earlier ones leave idle. After ``timeout`` seconds the jobs of a fit are cancelled and
    the model is recorded as failed. ``fitted`` models are scored without a new fit. All models are
    scored in one pass over the rows. ``training_report`` joins metrics and errors in one table.
    """
    params, trainers = params or {}, trainers or TRAINERS
    sc = train.sparkSession.sparkContext
    models, errors = dict(fitted or {}), {}

    def fit(name: str):
        sc.setLocalProperty("spark.scheduler.pool", name)
        sc.setJobGroup(f"train-{name}", f"fit of {name}", interruptOnCancel=True)
        kw = dict(params.get(name, {}))
        if name == "boosted_trees" and kw.pop("use_validation", False):
            kw["validation"] = val
        try:
            return trainers[name](train, label=label, **kw)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    todo = [name for name in trainers if name not in models]
    running = {}
    for name in todo:
        running[name] = _Fit(fit, name)
        running[name].start()
    end = None if timeout is None else time.monotonic() + timeout
    for name, thread in running.items():
        thread.join(None if end is None else max(0.0, end - time.monotonic()))
        if thread.is_alive():
            sc.cancelJobGroup(f"train-{name}")
            errors[name] = f"TimeoutError: cancelled after {timeout} seconds"
        elif thread.error is not None:
            errors[name] = f"{type(thread.error).__name__}: {thread.error}"
        else:
            models[name] = thread.model
    if not models:
        raise RuntimeError(f"no model could be fitted: {errors}")
    models = {name: models[name] for name in [*trainers, *models] if name in models}
    return models, regression_metrics(score_long(models, train.withColumn("split", F.lit("train")).unionByName(
        val.withColumn("split", F.lit("val"))), key, label)), errors


class _Fit(InheritableThread):
    """One fit; keeps its model or its error."""

    def __init__(self, fit, name: str):
        self.model = self.error = None

        def run():
            try:
                self.model = fit(name)
            except Exception as e:  # noqa: BLE001 - recorded per model and returned
                self.error = e
        super().__init__(target=run, name=f"train-{name}", daemon=True)


def score_long(models: dict, rows: DataFrame, key: str = "fare_key", label: str = "price") -> DataFrame:
    """Predictions of several models in long form, from one pass over the assembled rows."""
    out = rows
    for i, model in enumerate(models.values()):
        out = model.copy({model.predictionCol: f"_p{i}"}).transform(out)
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, name in enumerate(models)])
    keep = [c for c in (key, "split") if c in rows.columns]
    return out.select(*keep, F.col(label).alias("y"), F.explode(each).alias("p")).select(*keep, "p.model", "y", "p.prediction")


def training_report(metrics: DataFrame, errors: dict[str, str]) -> DataFrame:
    """The metric table with one more row for every model that failed (null metrics, its ``error``)."""
    out = metrics.withColumn("error", F.lit(None).cast("string"))
    if not errors:
        return out
    failed = metrics.sparkSession.createDataFrame(sorted(errors.items()), "model string, error string")
    return out.unionByName(failed, allowMissingColumns=True)


# ---------------------------------------------------------------- K8, M14
def top_features(model, feature_cols: list[str], n: int = 15) -> DataFrame:
    """K8: feature importances (tree models) or absolute coefficients, largest first."""
    spark = SparkSession.active()
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    rows = list(zip(feature_cols, [float(v) for v in vals]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def pca_reduce(df: DataFrame, k: int = 4, features: str = "features", out: str = "pca_features"):
    """Principal components of the feature vector."""
    model = PCA(k=k, inputCol=features, outputCol=out).fit(df)
    return model, model.transform(df)


# ---------------------------------------------------------------- S10
def save_model(model, path: str, metrics: DataFrame | None = None, params: dict | None = None) -> None:
    """Save a fitted model with its metric table and training parameters."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    rows = [(k, json.dumps(v)) for k, v in sorted((params or {}).items())]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").parquet(f"{path}/params")


def load_model(path: str):
    """Load any model written by ``save_model`` (its class is read from its metadata)."""
    spark = SparkSession.active()
    meta = DefaultParamsReader.loadMetadata(f"{path}/model", spark)
    module, _, name = meta["class"].replace("org.apache.spark", "pyspark").rpartition(".")
    return getattr(import_module(module), name).load(f"{path}/model")


def load_training(path: str) -> tuple[DataFrame, dict]:
    """Metric table and parameters saved with a model."""
    spark = SparkSession.active()
    params = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/params").collect()}
    return spark.read.parquet(f"{path}/metrics"), params


__all__ = ["assemble", "train_ridge", "train_forest", "train_boosted", "predict", "residuals", "regression_metrics",
           "best_model", "compare_models", "ensemble", "wide_predictions", "DEFAULT_GRID", "fits_at_a_time", "grid_tune", "train_all", "score_long", "training_report", "top_features",
           "pca_reduce", "best_round", "rounds_of", "save_model", "load_model", "load_training"]
