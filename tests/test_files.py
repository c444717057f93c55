"""CSV sources (S1-S3) read with declared schemas give the same table as the views."""

import tempfile

from pyspark.sql import functions as F

from farelens.plans import base
from farelens.sources import files, tables
from farelens.sources.calendar import raw_calendar

SF = "/root/testdata/sf0.001"


def test_fare_files_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="fare-files-")
    clean = tables.clean_file(spark, SF).withColumn("Unnamed: 0", F.monotonically_increasing_id())
    cols = [f.name for f in files.CLEAN_FILE_SCHEMA.fields]
    clean.select(*cols).coalesce(1).write.option("header", True).csv(f"{folder}/Clean_Dataset.csv")
    for name, df, schema in (("business.csv", tables.business_file(spark, SF), files.BUSINESS_FILE_SCHEMA),
                             ("economy.csv", tables.economy_file(spark, SF), files.ECONOMY_FILE_SCHEMA)):
        df.select(*[f.name for f in schema.fields]).coalesce(1).write.option("header", True).csv(f"{folder}/{name}")
    got = files.read_fare_files(spark, folder)
    want = base.standard_union(spark, SF)
    key = ["price", "date", "airline", "from", "to", "class", "time_taken"]
    a = sorted((tuple(r) for r in got.select(*key).collect()), key=repr)
    b = sorted((tuple(r) for r in want.select(*key).collect()), key=repr)
    assert a == b


def test_calendar_file_accepts_both_date_forms(spark):
    folder = tempfile.mkdtemp(prefix="calendar-")
    raw = raw_calendar(spark).select(F.col("date_text").alias("date"), "holiday_name", "is_national_holiday",
                                     "holiday_type", "year", F.lit(3.0).alias("holiday_impact_score"))
    raw.coalesce(1).write.option("header", True).csv(f"{folder}/cal.csv")
    cal = files.read_calendar(spark, f"{folder}/cal.csv")
    assert cal.where(F.col("date").isNull()).count() == 0
    assert cal.count() == raw.count()


def test_read_or_build_builds_once(spark):
    path = tempfile.mkdtemp(prefix="rob-") + "/t"
    calls = []

    def build():
        calls.append(1)
        return base.series(spark, SF)
    a = files.read_or_build(spark, path, build)
    b = files.read_or_build(spark, path, build)
    assert len(calls) == 1 and a.count() == b.count() > 0
