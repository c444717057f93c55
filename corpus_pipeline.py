"""Corpus pipeline: toxic documents go, repeated lines, near copies and passages go, the rest is packed.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. A document that a stage does not reject keeps its row; where
its text changes, ``n_chars`` follows.

Rows with a null id or text pass every stage unchanged, but for the first: it never reads the id and
scores a null text as a text without evidence, so that such rows stay unless the labels call most texts toxic.
Rows repeated under the one kept id of a group of near copies all stay. ORACLE_SQL is None: the
toxicity model cannot be expressed in SQL; the operators are tested against brute force, the stages
and their sequence in tests/llm/test_pipeline.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.llm.line_dedup import line_dedup
from farelens.llm.ngram_join import ngram_jaccard_join
from farelens.llm.packing import best_fit_packing
from farelens.llm.scratch import write_once
from farelens.llm.substring_dedup import substring_dedup
from farelens.llm.toxicity import fit_toxicity, score_toxicity

ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, longer where the documents have a column of that name."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (threshold 0.3) does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = (_unused(docs, name) for name in ("toxic_score", "toxic_predicted"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 0).drop(score, predicted)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of two or more lines, or of one line of 20 bytes or more; one that
    loses all lines stays, empty."""
    return _recount(line_dedup(docs, min_lines=2, min_bytes=20))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group under 5-word shingle similarity of 0.8."""
    groups = ngram_jaccard_join(docs, words=5, threshold=(8, 10))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of 20-word windows that also start earlier."""
    return _recount(substring_dedup(docs, window=20))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 512 to 4096 words."""
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written once and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
