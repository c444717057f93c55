"""Folders, scopes and guards against incomplete or repeated rows."""

import os

import pytest
from pyspark.sql import functions as F

from farelens import session
from farelens.operators import enrich
from farelens.operators.analytics import sequence_windows
from farelens.sources import files


def test_incomplete_folder_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "t")
    files.read_or_build(spark, path, lambda: spark.range(10))
    os.remove(os.path.join(path, "_SUCCESS"))
    assert files.read_or_build(spark, path, lambda: spark.range(7)).count() == 7
    assert files.read_or_build(spark, path, lambda: spark.range(99)).count() == 7


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_scope_deletes_what_it_made(spark):
    with session.scratch_scope(spark) as made:
        path = session.scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert made == [path] and files.path_exists(spark, path)
    assert not files.path_exists(spark, path)
    with pytest.raises(RuntimeError), session.scratch_scope(spark):
        path = session.scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        raise RuntimeError
    assert not files.path_exists(spark, path)


def test_series_with_a_repeated_day_does_not_repeat_fares(spark):
    fares = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-02")], "fare_key string, date string").withColumn(
        "date", F.to_date("date"))
    series = spark.createDataFrame([("2020-01-01", 5.0, 1.0), ("2020-01-01", 3.0, 2.0)],
                                   "date string, fuel_price_usd_per_barrel double, fuel_price_inr_per_liter double").withColumn(
        "date", F.to_date("date"))
    rows = {r.fare_key: r.fuel_price_usd_per_barrel for r in enrich.join_daily_series(fares, series).collect()}
    assert rows == {"a": 3.0, "b": None}


def test_windows_longer_than_a_bucket_are_refused(spark):
    with pytest.raises(ValueError, match="bucket_rows"):
        sequence_windows(spark.range(50).withColumn("g", F.lit(1)), ["g"], ["id"], ["id"], "id", length=10, bucket_rows=4)
