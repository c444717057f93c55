"""The fused preparation fit equals the step-by-step fit (M1 -> M3 -> M4)."""

from pyspark.sql import functions as F

from farelens.operators import encode as M
from farelens.plans import base
from farelens.plans.q_features import feature_table

SF = "/root/testdata/sf0.001"


def test_fused_state_equals_stepwise(spark):
    feats = feature_table(spark, SF)
    enc, _ = M.encode_categories(feats)
    x, cols, medians = M.feature_matrix(enc)
    stepwise, scaler = M.robust_scale(x, cols)
    state = M.fit_matrix_state(feats)
    assert state["feature_columns"] == cols
    assert state["medians"] == medians
    assert state["scaler"] == scaler
    fused = M.transform_matrix(feats, state)
    a = sorted(tuple(r) for r in stepwise.select("fare_key", *cols).collect())
    b = sorted(tuple(r) for r in fused.select("fare_key", *cols).collect())
    assert a == b


def test_prepare_writes_disjoint_complete_splits(spark):
    from farelens.plans.prep import prepare
    out = prepare(spark, base.fares_dirty(spark, SF), base.series(spark, SF), base.calendar(spark),
                  price_source="price_text")
    t = out["table"]
    n = t.count()
    assert n > 0 and t.select("fare_key").distinct().count() == n
    assert {r.split for r in t.select("split").distinct().collect()} <= {"train", "val", "test"}
    assert t.where(F.col("split") == "train").count() > 0


def test_loaded_state_scores_unseen_labels_and_new_nulls(spark):
    """Fit on all columns, save, load, and score rows with a new carrier and a null elsewhere."""
    from farelens.operators.models import assemble
    from farelens.session import scratch_path
    from farelens.sources import files
    feats = feature_table(spark, SF)
    state = M.fit_matrix_state(feats)
    assert set(state["medians"]) == set(state["feature_columns"])
    path = scratch_path(spark, "state")
    files.save_matrix_state(spark, path, state)
    loaded = files.load_matrix_state(spark, path)
    assert {k: loaded[k] for k in ("medians", "scaler", "feature_columns", "categorical")} == \
        {k: state[k] for k in ("medians", "scaler", "feature_columns", "categorical")}
    old = M.transform_matrix(feats, state).orderBy("fare_key").limit(50).collect()
    assert old == M.transform_matrix(feats, loaded).orderBy("fare_key").limit(50).collect()
    odd = feats.limit(20).withColumns({"airline": F.lit("NewAir"), "month": F.lit(None).cast("int"),
                                       "flight_hours": F.lit(None).cast("double")})
    x = assemble(M.transform_matrix(odd, loaded), loaded["feature_columns"])
    assert x.where("features is not null").count() == 20
    top = loaded["vocab"].where("column = 'airline'").agg(F.max("idx")).first()[0]
    enc = M.apply_vocabulary(odd, loaded["vocab"], ["airline"])
    assert {r.airline_encoded for r in enc.collect()} == {top + 1}


def test_empty_parts_of_a_state_survive(spark):
    from farelens.session import scratch_path
    from farelens.sources import files
    path = scratch_path(spark, "state")
    files.save_prep_state(spark, path, None, {"scaler": {}, "medians": {"a": 1.0}, "feature_columns": ["b", "a"], "categorical": []})
    assert files.load_prep_state(spark, path) == (None, {"scaler": {}, "medians": {"a": 1.0}, "feature_columns": ["b", "a"], "categorical": []})


def test_state_fitted_on_the_training_rows_only(spark):
    from farelens.plans.prep import prepare
    raw, series, cal = base.fares_dirty(spark, SF), base.series(spark, SF), base.calendar(spark)
    out = prepare(spark, raw, series, cal, price_source="price_text", fit_on="train")
    train = M.split_rows(out["features"]).where("split = 'train'").drop("split")
    state = M.fit_matrix_state(train)
    assert out["scaler"] == state["scaler"] and out["medians"] == state["medians"]
    whole = prepare(spark, raw, series, cal, price_source="price_text")
    assert whole["scaler"] != out["scaler"] and whole["table"].count() == out["table"].count()


def test_prepare_leaves_its_results_only(spark):
    from farelens.plans.prep import prepare
    from farelens.session import checkpoint_root
    from farelens.sources import files
    import os
    root = f"{checkpoint_root(spark)}/farelens".replace("file:", "")
    before = set(os.listdir(root))
    prepare(spark, base.fares_dirty(spark, SF), base.series(spark, SF), base.calendar(spark), price_source="price_text")
    made = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before}
    assert not made & {"deduplicated", "cleaned", "fill-histogram"} and {"features", "prepared"} <= made
    assert files.path_exists(spark, root)
