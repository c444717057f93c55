"""The notebook feature set as ``pyspark.ml`` stages (F8-F12, M1's second column set, P15's zero fill).

Three stages of our own, each readable and writable, so that one ``PipelineModel`` holds everything from
the clean-file row to the prediction: row features, labels numbered by their sorted order, and the zero fill.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, Window, functions as F

from farelens.constants import NOTEBOOK_CATEGORICALS
from farelens.operators import encode as M
from farelens.operators.features import notebook_features
from farelens.operators.stats import bounded_broadcast, code_boundary, materialize

NOTEBOOK_NUMERIC = ["duration", "days_left", "departure_hour", "arrival_hour", "is_budget_airline", "has_stops", "is_premium_class",
                    "is_last_minute"]


class NotebookFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Route, hours, flags and bands of a clean-file shaped row."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return notebook_features(dataset)


class SortedLabels(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M1: numbers the labels of ``inputCols`` by their sorted order (``<column>_encoded``); null is the label ``nan``."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, dataset: DataFrame) -> SortedLabelsModel:
        model = SortedLabelsModel(M.fit_vocabulary(dataset, self.getInputCols()))
        model._set(inputCols=self.getInputCols())
        model._resetUid(self.uid)
        return model


class _LabelsWriter(MLWriter):
    def __init__(self, instance: SortedLabelsModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.vocabulary.write.parquet(f"{path}/vocabulary")


class _LabelsReader(MLReader):
    def load(self, path: str) -> SortedLabelsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = SortedLabelsModel(self.sparkSession.read.parquet(f"{path}/vocabulary"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class SortedLabelsModel(Model, HasInputCols, MLReadable, MLWritable):
    """The fitted numbering: a table ``(column, value, idx)``, saved as one beside the parameters."""

    def __init__(self, vocabulary: DataFrame | None = None):
        super().__init__()
        self.vocabulary = vocabulary

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return M.apply_vocabulary(dataset, self.vocabulary, self.getInputCols())

    def write(self) -> MLWriter:
        return _LabelsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LabelsReader()


class ZeroFill(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """P15 of the notebook: nulls of the feature columns become 0."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.getInputCols()})


def notebook_pipeline(regressor, features: str = "features") -> Pipeline:
    """Features, labels, zero fill, vector and ``regressor`` in one pipeline over clean-file shaped rows."""
    columns = NOTEBOOK_NUMERIC + [f"{c}_encoded" for c in NOTEBOOK_CATEGORICALS]
    return Pipeline(stages=[NotebookFeatures(), SortedLabels(inputCols=NOTEBOOK_CATEGORICALS), ZeroFill(inputCols=columns),
                            VectorAssembler(inputCols=columns, outputCol=features), regressor])


def fit_written(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """``pipeline.fit(train)``; the regressor at its end, which passes over its rows twice, reads label and vector from a written table."""
    *before, regressor = pipeline.getStages()
    head = Pipeline(stages=before).fit(train)
    written = materialize(head.transform(train).select(regressor.getLabelCol(), regressor.getFeaturesCol()), "assembled")
    return PipelineModel([*head.stages, regressor.fit(written)])


def compare_scorings(rows: DataFrame, model: PipelineModel, other: PipelineModel, key: str = "fare_key") -> DataFrame:
    """``rows`` with ``same``: do the two pipelines predict alike for their key?

    Rows whose key is theirs alone are scored by both in one pass and stay where they are. Only rows that share a key (found by
    the hashes of the keys; one that two keys share costs time only) are shuffled: each is compared with every pair of rows of its
    key, as a join of rows and scorings by key would, so a key of n rows gives n * n * n. Null keys meet nothing.
    """
    hashed = rows.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(key))
    shared = bounded_broadcast(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))

    def scored(how: str) -> DataFrame:
        out = hashed.join(shared, "_h", how).select(*rows.columns)
        for pipeline, name in ((model, "_p"), (other, "_q")):
            # the zero fill of a pipeline overwrites columns of the row, so copies pass beside it
            held = {f"_held{i}": c for i, c in enumerate(out.columns)}
            scores = pipeline.transform(out.select("*", *[F.col(c).alias(h) for h, c in held.items()]))
            out = code_boundary(scores.select(*[F.col(h).alias(c) for h, c in held.items()], F.col("prediction").alias(name)))
        return out

    alone = scored("left_anti").select(*rows.columns, (F.col("_p") == F.col("_q")).alias("same"))
    pairs = F.collect_list(F.struct("_p", "_q")).over(Window.partitionBy(key))
    same = F.flatten(F.transform("_pairs", lambda a: F.transform("_pairs", lambda b: a["_p"] == b["_q"])))
    return alone.unionByName(scored("left_semi").withColumn("_pairs", pairs).select(*rows.columns, F.explode(same).alias("same")))


__all__ = ["NotebookFeatures", "SortedLabels", "SortedLabelsModel", "ZeroFill", "notebook_pipeline", "fit_written", "compare_scorings",
           "NOTEBOOK_NUMERIC"]
