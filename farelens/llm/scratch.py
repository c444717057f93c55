"""Intermediate tables of the corpus operators in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelens.session import scratch_path


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The plan of ``df`` runs exactly once, and what is read back depends on committed files
    alone, so the loss of an executor later costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


BATCH_BYTES = 4 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts by bytes, unless the session or the cluster has set a bound.

    By rows alone a batch of long texts takes hundreds of MB in the executor and again in its worker.
    """
    if spark.sparkContext.getConf().contains(_BYTES_PER_BATCH):
        return
    if spark.conf.get(_BYTES_PER_BATCH) == str(64 << 20):        # Spark's default
        spark.conf.set(_BYTES_PER_BATCH, str(BATCH_BYTES))
