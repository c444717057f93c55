"""Feature matrix: label vocabularies, median fill, robust scaling, stable split.

Fitted state is data, not pickles:

* vocabularies are a table ``(column, value, idx)`` computed with distributed
  ranks (``stats.rank_intervals`` over the distinct values), kept as a
  DataFrame and joined back with a size-checked broadcast;
* medians, quartiles and min/max are one small row per column, fitted in one
  job and applied as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from farelens.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from farelens.operators.stats import bounded_broadcast, code_boundary, fit_quantiles, materialize, rank_intervals

NULL_LABEL = "nan"


def _label(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL_LABEL))


def _long_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _label(c).alias("value")) for c in columns])).alias("kv")
    ).select("kv.column", "kv.value")


def fit_vocabulary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``idx`` = rank of the value among the sorted distinct values of its column.

    The distinct labels (one pass over ``df``, combined map-side) and the
    fitted vocabulary are written to the shared checkpoint folder: ranking
    reads the labels three times and callers read the vocabulary several
    times, and neither may re-scan the fare rows.
    """
    columns = [c for c in (columns or CATEGORICAL_FEATURES) if c in df.columns]
    distinct = materialize(_long_labels(df, columns).distinct(), "labels").withColumn("cnt", F.lit(1))
    ranked = rank_intervals(distinct, ["column"], "value", groups_bounded=True)
    return materialize(ranked.select("column", "value", F.col("_lo").cast("int").alias("idx")), "vocabulary")


def extend_vocabulary(vocab: DataFrame, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values not in ``vocab`` are appended after the column's largest index.

    New values are numbered in sorted order (an order of first appearance does
    not exist in a distributed table).
    """
    columns = [c for c in (columns or CATEGORICAL_FEATURES) if c in df.columns]
    seen = materialize(_long_labels(df, columns).distinct(), "labels")
    unseen = seen.join(vocab.select("column", "value"), ["column", "value"], "left_anti").withColumn("cnt", F.lit(1))
    ranked = rank_intervals(unseen, ["column"], "value", groups_bounded=True)
    top = vocab.groupBy("column").agg(F.max("idx").alias("_top"))
    new = ranked.join(top, "column", "left").select(
        "column", "value", (F.coalesce(F.col("_top"), F.lit(-1)) + F.col("_lo") + F.lit(1)).cast("int").alias("idx"))
    return vocab.unionByName(new)


def apply_vocabulary(df: DataFrame, vocab: DataFrame, columns: list[str] | None = None,
                     max_bytes: int = 64 << 20, unknown: str = "next") -> DataFrame:
    """Add ``<column>_encoded`` for every column of the vocabulary present in ``df``.

    The vocabulary is checked for size once and broadcast; past ``max_bytes``
    the joins fall back to shuffle joins. A label that the vocabulary does not
    hold gets the column's next free index (one index for all unseen labels:
    the row-local form of M2, which also works on a stream), or null with
    ``unknown="null"``.
    """
    if unknown not in ("next", "null"):
        raise ValueError("unknown must be 'next' or 'null'")
    columns = [c for c in (columns or CATEGORICAL_FEATURES) if c in df.columns]
    small = bounded_broadcast(vocab, max_bytes)
    free = {r["column"]: r["n"] + 1 for r in vocab.groupBy("column").agg(F.max("idx").alias("n")).collect()}
    out = df
    for c in columns:
        v = small.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"),
                                                     F.col("idx").alias(f"{c}_encoded"))
        out = out.join(v, _label(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
        if unknown == "next":
            out = out.withColumn(f"{c}_encoded", F.coalesce(F.col(f"{c}_encoded"), F.lit(free.get(c, 0))))
    return out


def encode_categories(df: DataFrame, columns: list[str] | None = None, vocab: DataFrame | None = None):
    """M1/M2: fit (or extend) the vocabulary and encode; returns ``(encoded, vocab)``."""
    vocab = fit_vocabulary(df, columns) if vocab is None else extend_vocabulary(vocab, df, columns)
    return apply_vocabulary(df, vocab, columns), vocab


# ---------------------------------------------------------------- M3
def feature_columns(df: DataFrame, numeric=None) -> list[str]:
    """The named numeric features and every ``*_encoded`` column that exist."""
    wanted = list(numeric or NUMERIC_FEATURES) + [c for c in df.columns if c.endswith("_encoded")]
    return [c for c in wanted if c in df.columns]


def feature_matrix(df: DataFrame, features: list[str] | None = None, keep=("fare_key", "price"),
                   medians: dict | None = None):
    """M3: feature columns as doubles, nulls filled with the column median.

    Medians are fitted for every column in one job, because rows scored later may hold nulls
    where the fitting data had none. Returns ``(matrix, features, medians)``.
    """
    features = features or feature_columns(df)
    cols = [F.col(c).cast("double").alias(c) for c in features]
    x = df.select(*[k for k in keep if k in df.columns], *cols)
    if medians is None:
        medians = {c: v["median"] for c, v in fit_quantiles(x, features, {"median": 0.5}).items()} if features else {}
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in medians.items() if v is not None}
    return (x.withColumns(fills) if fills else x), features, medians


# ---------------------------------------------------------------- M4
def fit_robust_scaler(df: DataFrame, columns: list[str]) -> dict:
    """Median and IQR per column (exact quartiles); a zero IQR scales by 1."""
    q = fit_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    params = {}
    for c in columns:
        if c in q:
            iqr = q[c]["q3"] - q[c]["q1"]
            params[c] = (q[c]["median"], iqr if iqr != 0 else 1.0)
    return params


def robust_scale(df: DataFrame, columns: list[str], params: dict | None = None, fit: bool = True):
    """M4: ``(x - median) / IQR``; ``fit=False`` needs previously fitted ``params``."""
    if params is None:
        if not fit:
            raise ValueError("robust_scale needs params when fit is off")
        params = fit_robust_scaler(df, columns)
    scaled = {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items() if c in df.columns}
    return df.withColumns(scaled), params


# ---------------------------------------------------------------- M5
def split_bucket(key: F.Column) -> F.Column:
    """0..99 from the first 8 hex digits of ``md5(key)``: stable across runs and engines."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def split_rows(df: DataFrame, key: str = "fare_key", test_size: float = 0.2, val_size: float = 0.2) -> DataFrame:
    """M5: ``split`` column train/val/test by a stable hash bucket (sizes approximate)."""
    b = split_bucket(F.col(key))
    train_top = int(round((1 - test_size - val_size) * 100))
    val_top = int(round((1 - test_size) * 100))
    return df.withColumn("split", F.when(b < train_top, "train").when(b < val_top, "val").otherwise("test"))


# ---------------------------------------------------------------- F14
def phase_features(df: DataFrame, columns: list[str], keep=("fare_key",)) -> DataFrame:
    """angle features of the first four columns, pair products, and ``atan2`` phases.

    Min and max per column are fitted in one aggregate and applied as literals.
    """
    cols = list(columns)
    k = len(cols)
    first = cols[:min(4, k)]
    mm = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(first)],
                *[F.max(c).alias(f"hi{i}") for i, c in enumerate(first)]).first()
    out = []
    two_pi = 2 * 3.141592653589793
    for i, c in enumerate(first):
        lo, hi = float(mm[f"lo{i}"]), float(mm[f"hi{i}"])
        norm = (F.col(c) - F.lit(lo)) / F.lit(hi - lo + 1e-8) * F.lit(two_pi)
        out += [F.sin(norm).alias(f"amp_sin_{i}"), F.cos(norm).alias(f"amp_cos_{i}")]
    for i in range(min(2, k - 1)):
        for j in range(i + 1, min(4, k)):
            out += [(F.col(cols[i]) * F.col(cols[j])).alias(f"ent_prod_{i}_{j}"),
                    (F.sin(F.col(cols[i])) * F.cos(F.col(cols[j]))).alias(f"ent_sc_{i}_{j}")]
    for i in range(min(3, k)):
        ph = F.atan2(F.col(cols[i]), F.col(cols[(i + 1) % k]))
        out += [F.sin(ph).alias(f"phase_sin_{i}"), F.cos(ph).alias(f"phase_cos_{i}")]
    return df.select(*[c for c in keep if c in df.columns], *out)


# ---------------------------------------------------------------- fused fit of M1 + M3 + M4
def fit_matrix_state(feats: DataFrame, numeric=None, categorical=None) -> dict:
    """Vocabularies, fill medians and scaler statistics from ONE pass over ``feats``.

    A single value histogram of every categorical and numeric feature is
    written once; then, from that small table only:

    * vocabulary ranks of the categorical values (M1);
    * null counts and medians of the numeric columns (M3);
    * quartiles of the *filled, encoded* matrix (M4): encoded columns take the
      histogram of their labels mapped to indexes, numeric columns take their
      non-null histogram plus the null count placed at the median.

    The result equals fitting M1, M3 and M4 one after another.
    """
    from farelens.operators.stats import (materialize, quantiles_from_histogram, value_histogram)
    categorical = [c for c in (categorical or CATEGORICAL_FEATURES) if c in feats.columns]
    numeric = [c for c in (numeric or NUMERIC_FEATURES) if c in feats.columns]
    hist = materialize(value_histogram(feats, categorical, numeric, null_label=NULL_LABEL), "matrix-histogram")
    cat_hist = hist.where(F.col("column").isin(categorical)).select("column", F.col("s").alias("value"), "cnt")
    vocab = materialize(rank_intervals(cat_hist.select("column", "value").withColumn("cnt", F.lit(1)), ["column"],
                                       "value", groups_bounded=True)
                        .select("column", "value", F.col("_lo").cast("int").alias("idx")), "vocabulary")
    num_hist = hist.where(F.col("column").isin(numeric)).select("column", "v", "cnt")
    nulls = {r["column"]: r["cnt"] for r in num_hist.where(F.col("v").isNull()).collect()}
    medians = {r["column"]: r["median"] for r in quantiles_from_histogram(
        num_hist, ["column"], "v", {"median": 0.5}, groups_bounded=True).collect()}
    spark = feats.sparkSession
    fill_rows = [(c, float(medians[c]), int(n)) for c, n in nulls.items() if medians.get(c) is not None]
    filled = num_hist.where(F.col("v").isNotNull())
    if fill_rows:
        filled = filled.unionByName(spark.createDataFrame(fill_rows, "column string, v double, cnt long"))
    enc_hist = cat_hist.join(vocab, ["column", "value"]).select(
        F.concat(F.col("column"), F.lit("_encoded")).alias("column"), F.col("idx").cast("double").alias("v"), "cnt")
    q = quantiles_from_histogram(filled.unionByName(enc_hist), ["column"], "v",
                                 {"q1": 0.25, "median": 0.5, "q3": 0.75}, groups_bounded=True).collect()
    # an encoded column has no nulls in the fit; its median is the scaler's
    medians |= {r["column"]: r["median"] for r in q if r["column"] not in numeric}
    scaler = {}
    for r in q:
        iqr = r["q3"] - r["q1"]
        scaler[r["column"]] = (r["median"], iqr if iqr != 0 else 1.0)
    features = numeric + [f"{c}_encoded" for c in categorical]
    return {"vocab": vocab, "medians": medians, "scaler": scaler, "feature_columns": features,
            "categorical": categorical}


def scaled_column(col: F.Column, name: str, state: dict) -> F.Column:
    """``col`` as a double, filled with the fitted median of feature ``name`` and scaled with its fitted centre and scale."""
    x = col.cast("double")
    fill = state["medians"].get(name)
    x = x if fill is None else F.coalesce(x, F.lit(float(fill)))
    if name not in state["scaler"]:
        return x
    centre, scale = state["scaler"][name]
    return (x - F.lit(float(centre))) / F.lit(float(scale))


def transform_matrix(feats: DataFrame, state: dict, keep=("fare_key", "price")) -> DataFrame:
    """Encode, select, fill and scale with a fitted ``state`` (one narrow pass + broadcast joins).

    Numbers are filled and scaled below the joins that number the labels, labels above them: all columns in
    one method would be too long for the JVM to compile (``stats.code_boundary``).
    """
    features, labels = state["feature_columns"], [c for c in state["categorical"] if c in feats.columns]
    encoded = {f"{c}_encoded" for c in labels}
    keep = [k for k in keep if k in feats.columns]
    number = {c: f"_x{i}_" for i, c in enumerate(features) if c not in encoded}
    x = feats.select(*dict.fromkeys([*keep, *labels]), *[scaled_column(F.col(c), c, state).alias(n) for c, n in number.items()])
    x = apply_vocabulary(code_boundary(x), state["vocab"], labels)
    return x.select(*keep, *[F.col(number[c]).alias(c) if c in number else scaled_column(F.col(c), c, state).alias(c) for c in features])
