"""Feature-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelens.constants import (BOOKING_BANDS, BUDGET_AIRLINES_NOTEBOOK, CATEGORICAL_FEATURES, DURATION_HOUR_BANDS, NOTEBOOK_CATEGORICALS,
                                NUMERIC_FEATURES, SLOT_HOURS)
from farelens.operators import encode as M
from farelens.operators.notebook import NOTEBOOK_NUMERIC, SortedLabels, ZeroFill, compare_scorings, fit_written, notebook_pipeline
from farelens.plans.oracle import _in, _map_case, band_case, with_ctes
from farelens.plans import base
from farelens.plans.q_features import feature_table
from farelens.operators.stats import materialize
from farelens.plans.registry import query
from farelens.session import scratch_path
from farelens.sources import tables

CATS = CATEGORICAL_FEATURES
ENCODED = [f"{c}_encoded" for c in CATS]
MATRIX = NUMERIC_FEATURES + ENCODED
CUTOFF = "1995-04-01"
NEW_VALUE_COLS = CATS


def _qi(c: str) -> str:
    return f'"{c}"'


def _label_sql(c: str) -> str:
    return f"coalesce(CAST({_qi(c)} AS VARCHAR), 'nan')"


ENC_CTE = "SELECT *, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {_label_sql(c)}) - 1 AS INTEGER) AS {c}_encoded" for c in CATS) + " FROM feat"
X_CTE = "SELECT fare_key, price, " + ", ".join(f"CAST({_qi(c)} AS DOUBLE) AS {_qi(c)}" for c in MATRIX) + " FROM enc"
FILLED_CTE = "SELECT fare_key, price, " + ", ".join(
    f"coalesce({_qi(c)}, (SELECT quantile_cont({_qi(c)}, 0.5) FROM x)) AS {_qi(c)}" for c in MATRIX) + " FROM x"
STATS_CTE = "SELECT " + ", ".join(
    f"quantile_cont({_qi(c)}, 0.25) AS q1_{i}, quantile_cont({_qi(c)}, 0.5) AS md_{i}, "
    f"quantile_cont({_qi(c)}, 0.75) AS q3_{i}" for i, c in enumerate(MATRIX)) + " FROM filled"
SCALED_CTE = "SELECT fare_key, price, " + ", ".join(
    f"({_qi(c)} - md_{i}) / CASE WHEN q3_{i} - q1_{i} = 0 THEN 1.0 ELSE q3_{i} - q1_{i} END AS {_qi(c)}"
    for i, c in enumerate(MATRIX)) + " FROM filled, st"
MATRIX_CTES = {"enc": ENC_CTE, "x": X_CTE, "filled": FILLED_CTE, "st": STATS_CTE, "scaled": SCALED_CTE}


def fitted(spark, d, extra=()):
    """The written feature table (key, price, ``extra`` and the columns of the matrix) and the state fitted on it in one pass."""
    feats = materialize(feature_table(spark, d, extra).select("fare_key", "price", *extra, *NUMERIC_FEATURES, *CATS), "features")
    return feats, M.fit_matrix_state(feats)


def encoded_table(spark, d):
    feats, state = fitted(spark, d)
    return M.apply_vocabulary(feats, state["vocab"], state["categorical"])


def filled_matrix(spark, d):
    feats, state = fitted(spark, d)
    enc = M.apply_vocabulary(feats, state["vocab"], state["categorical"])
    return M.feature_matrix(enc, state["feature_columns"], medians=state["medians"])[0]


def scaled_matrix(spark, d):
    return M.transform_matrix(*fitted(spark, d))


@query("encode_categories", with_ctes("SELECT fare_key, " + ", ".join(ENCODED) + " FROM enc", "feat",
                                      extra={"enc": ENC_CTE}))
def encode_categories(spark, d):
    return encoded_table(spark, d).select("fare_key", *ENCODED)


@query("label_rank", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS idx "
    f"FROM (SELECT DISTINCT {_label_sql(c)} AS value FROM feat)" for c in CATS), "feat"))
def label_rank(spark, d):
    return M.fit_vocabulary(feature_table(spark, d))


def _old_new(spark, d):
    """The feature table before and from the cutoff (written once: the vocabulary and the new labels read it)."""
    f = materialize(feature_table(spark, d).select("date", *NEW_VALUE_COLS), "labelled-features")
    return f.where(F.col("date") < F.lit(CUTOFF).cast("date")), f.where(F.col("date") >= F.lit(CUTOFF).cast("date"))


_OLD = f"(SELECT * FROM feat WHERE date < DATE '{CUTOFF}')"
_NEW = f"(SELECT * FROM feat WHERE date >= DATE '{CUTOFF}')"
UNSEEN_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", value FROM (SELECT DISTINCT {_label_sql(c)} AS value FROM {_NEW} "
    f"EXCEPT SELECT DISTINCT {_label_sql(c)} FROM {_OLD})" for c in NEW_VALUE_COLS)


@query("unseen_values", with_ctes(UNSEEN_SQL, "feat"))
def unseen_values(spark, d):
    old, new = _old_new(spark, d)
    vocab = M.fit_vocabulary(old, NEW_VALUE_COLS)
    ext = M.extend_vocabulary(vocab, new, NEW_VALUE_COLS)
    return ext.join(vocab.select("column", "value"), ["column", "value"], "left_anti").select("column", "value")


OLD_VOCAB = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS idx "
    f"FROM (SELECT DISTINCT {_label_sql(c)} AS value FROM {_OLD})" for c in NEW_VALUE_COLS)


@query("encode_new_values", with_ctes("""
SELECT "column", value, idx FROM old_vocab
UNION ALL
SELECT u."column", u.value,
       CAST(coalesce(t.top, -1) + dense_rank() OVER (PARTITION BY u."column" ORDER BY u.value) AS INTEGER) AS idx
FROM unseen u LEFT JOIN (SELECT "column", max(idx) AS top FROM old_vocab GROUP BY "column") t
  ON t."column" = u."column\"""", "feat", extra={"old_vocab": OLD_VOCAB, "unseen": UNSEEN_SQL}))
def encode_new_values(spark, d):
    old, new = _old_new(spark, d)
    return M.extend_vocabulary(M.fit_vocabulary(old, NEW_VALUE_COLS), new, NEW_VALUE_COLS)


@query("select_features", with_ctes("SELECT * FROM x", "feat", extra={"enc": ENC_CTE, "x": X_CTE}))
def select_features(spark, d):
    enc = encoded_table(spark, d)
    cols = M.feature_columns(enc)
    return enc.select("fare_key", "price", *[F.col(c).cast("double").alias(c) for c in cols])


@query("feature_matrix", with_ctes("SELECT * FROM filled", "feat",
                                   extra={k: MATRIX_CTES[k] for k in ("enc", "x", "filled")}))
def feature_matrix(spark, d):
    return filled_matrix(spark, d)


@query("robust_scale", with_ctes("SELECT * FROM scaled", "feat", extra=MATRIX_CTES))
def robust_scale(spark, d):
    return scaled_matrix(spark, d)


SPLIT_SQL = "CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END"


@query("split_rows", with_ctes(f"""
SELECT fare_key, {SPLIT_SQL} AS split
FROM (SELECT fare_key, CAST(('0x' || substr(md5(fare_key), 1, 8)) AS BIGINT) % 100 AS b FROM fares)""", "fares"))
def split_rows(spark, d):
    return M.split_rows(base.fares(spark, d)).select("fare_key", "split")


PHASE_COLS = ["year", "month", "quarter", "day"]


def _phase_sql() -> str:
    c = PHASE_COLS
    k = len(c)
    two_pi = 2 * 3.141592653589793
    out = []
    for i in range(4):
        norm = f"(({c[i]} - lo{i}) / (hi{i} - lo{i} + 1e-8) * {two_pi!r})"
        out += [f"round(sin({norm}), 6) AS amp_sin_{i}", f"round(cos({norm}), 6) AS amp_cos_{i}"]
    for i in range(2):
        for j in range(i + 1, 4):
            out += [f"round({c[i]} * {c[j]}, 6) AS ent_prod_{i}_{j}", f"round(sin({c[i]}) * cos({c[j]}), 6) AS ent_sc_{i}_{j}"]
    for i in range(3):
        ph = f"atan2({c[i]}, {c[(i + 1) % k]})"
        out += [f"round(sin({ph}), 6) AS phase_sin_{i}", f"round(cos({ph}), 6) AS phase_cos_{i}"]
    mm = ", ".join(f"min({c[i]}) AS lo{i}, max({c[i]}) AS hi{i}" for i in range(4))
    return f"SELECT fare_key, {', '.join(out)} FROM filled, (SELECT {mm} FROM filled) r"


@query("phase_features", with_ctes(_phase_sql(), "feat",
                                   extra={k: MATRIX_CTES[k] for k in ("enc", "x", "filled")}))
def phase_features(spark, d):
    x = filled_matrix(spark, d).select("fare_key", *PHASE_COLS)
    out = M.phase_features(x, PHASE_COLS)
    return out.select("fare_key", *[F.round(c, 6).alias(c) for c in out.columns if c != "fare_key"])


# ---------------------------------------------------------------- the notebook pipeline (F8-F12, M1's second set, P15)
NOTEBOOK_ENCODED = [f"{c}_encoded" for c in NOTEBOOK_CATEGORICALS]
_NOTEBOOK_CTES = {
    "nf": f"""SELECT *, source_city || '_' || destination_city AS route, {_map_case('departure_time', SLOT_HOURS)} AS departure_hour,
                {_map_case('arrival_time', SLOT_HOURS)} AS arrival_hour,
                CAST(coalesce({_in('airline', BUDGET_AIRLINES_NOTEBOOK)}, FALSE) AS INTEGER) AS is_budget_airline,
                CAST(coalesce(stops <> 'zero', TRUE) AS INTEGER) AS has_stops, CAST(coalesce(class = 'Business', FALSE) AS INTEGER) AS is_premium_class,
                CAST(coalesce(days_left <= 7, FALSE) AS INTEGER) AS is_last_minute, {band_case('days_left', BOOKING_BANDS)} AS booking_category,
                {band_case('duration', DURATION_HOUR_BANDS)} AS duration_category FROM clean_file""",
}


@query("notebook_pipeline", with_ctes("SELECT fare_key, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {_label_sql(c)}) - 1 AS INTEGER) AS {c}_encoded" for c in NOTEBOOK_CATEGORICALS) + ", " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NOTEBOOK_NUMERIC) + ", TRUE AS same FROM nf", "clean_file", extra=_NOTEBOOK_CTES))
def notebook_pipeline_q(spark, d):
    """Features, labels, fill and a regression fitted as one pipeline, saved, loaded, and compared row by row."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression
    rows = materialize(tables.clean_file(spark, d), "clean-file")
    train = rows.where(M.split_bucket(F.col("fare_key")) < 60)
    model = fit_written(notebook_pipeline(LinearRegression(labelCol="price", regParam=0.1)), train)
    path = scratch_path(spark, "notebook-pipeline")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    # numbers come from labels fitted on all rows, as in the notebook; the saved model scores with its own
    labels = SortedLabels(inputCols=NOTEBOOK_CATEGORICALS).fit(model.stages[0].transform(rows))
    numbered = labels.transform(model.stages[0].transform(compare_scorings(rows, model, back)))
    return ZeroFill(inputCols=NOTEBOOK_NUMERIC).transform(numbered).select("fare_key", *NOTEBOOK_ENCODED, *NOTEBOOK_NUMERIC, "same")
