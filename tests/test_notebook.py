"""The notebook pipeline: fit over written vectors, scorings compared by key."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from farelens.operators.notebook import compare_scorings, fit_written, notebook_pipeline

SCHEMA = ("fare_key string, airline string, flight string, source_city string, destination_city string, departure_time string, "
          "arrival_time string, stops string, class string, duration double, days_left int, price double")


@pytest.fixture(scope="module")
def rows(spark):
    made = [(f"k{i}", ["A", "B", None][i % 3], f"f{i % 4}", "Delhi", ["Pune", "Goa"][i % 2], "Morning", "Night", ["zero", "one"][i % 2],
             "Economy", 1.0 + i % 7, i % 50 or None, 100.0 + 13 * i) for i in range(40)]
    again = [made[3][:-2] + (9, 5.0), made[3], made[8]]      # one key three times, one twice
    return spark.createDataFrame([*made, *again, (None, *made[5][1:])], SCHEMA)


@pytest.fixture(scope="module")
def pipeline():
    return notebook_pipeline(LinearRegression(labelCol="price", regParam=0.1))


@pytest.fixture(scope="module")
def model(rows, pipeline):
    return fit_written(pipeline, rows)


def test_fit_over_written_vectors_equals_the_pipeline(rows, pipeline, model):
    theirs = pipeline.fit(rows)
    assert isinstance(model, PipelineModel) and [type(s) for s in model.stages] == [type(s) for s in theirs.stages]
    assert model.stages[-1].coefficients.toArray() == pytest.approx(theirs.stages[-1].coefficients.toArray(), abs=1e-6)


def test_scorings_meet_by_key_and_lone_keys_stay_in_place(rows, pipeline, model):
    other = fit_written(pipeline, rows.where("price > 200"))
    for second in (model, other):
        got = compare_scorings(rows, model, second)
        p, q = (m.transform(rows).select("fare_key", F.col("prediction").alias(n)) for m, n in ((model, "p"), (second, "q")))
        joined = rows.join(p.join(q, "fare_key").select("fare_key", (F.col("p") == F.col("q")).alias("same")), "fare_key")
        made = sorted(map(repr, got.select(*rows.columns, "same").collect()))
        assert len(made) == 38 + 27 + 8 and made == sorted(map(repr, joined.select(*rows.columns, "same").collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(fare_key") == 1
