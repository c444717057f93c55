"""Standardising and cleaning fare tables.

Statistics used by the cleaning steps (modes, medians, IQR bounds) are fitted
in one distributed job each and applied as literals, like a fitted Spark ML
model; no step collects rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from farelens.constants import CLEAN_RENAMES, DAYS_LEFT_BASE_DATE, TIME_LABEL_FIXES
from farelens.functions.lookups import relabel
from farelens.functions.text import (carrier_code, digits_and_dot, flight_number, parse_dmy,
                                     parse_price_text, standard_duration)
from farelens.operators.stats import (exact_quantiles, materialize, modes_from_histogram, quantiles_from_histogram,
                                      value_histogram)


def _is_string(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


# ---------------------------------------------------------------- standardise
def rename_columns(df: DataFrame, renames: dict | None = None) -> DataFrame:
    """Clean-file column names -> common names (only those present)."""
    renames = {k: v for k, v in (renames or CLEAN_RENAMES).items() if k in df.columns}
    return df.withColumnsRenamed(renames)


def date_from_days_left(df: DataFrame, base_date: str = DAYS_LEFT_BASE_DATE) -> DataFrame:
    """``date = base + days_left`` (or the base date when there is no days_left)."""
    base = F.to_date(F.lit(base_date))
    if "days_left" in df.columns:
        return df.withColumn("date", F.date_add(base, F.col("days_left").cast("int")))
    return df.withColumn("date", base)


def add_carrier_code(df: DataFrame) -> DataFrame:
    """``ch_code`` = first two letters of the airline, if absent."""
    return df if "ch_code" in df.columns else df.withColumn("ch_code", carrier_code(F.col("airline")))


def add_flight_number(df: DataFrame) -> DataFrame:
    """``num_code`` = first digit run of the flight code, default ``'000'``."""
    return df if "num_code" in df.columns else df.withColumn("num_code", flight_number(F.col("flight")))


def add_time_taken(df: DataFrame) -> DataFrame:
    """P5: ``time_taken`` text from decimal-hour ``duration``, if absent."""
    if "time_taken" in df.columns:
        return df
    return df.withColumn("time_taken", standard_duration(F.col("duration"), _is_string(df, "duration")))


def standardize_clean(df: DataFrame) -> DataFrame:
    """The clean fare file: date from days_left, common names, carrier/flight/time codes."""
    return (df.transform(date_from_days_left).transform(rename_columns)
            .transform(add_carrier_code).transform(add_flight_number).transform(add_time_taken))


def parse_dates(df: DataFrame, source: str, target: str = "date") -> DataFrame:
    """``dd-mm-yyyy`` text -> date; malformed -> null."""
    return df.withColumn(target, parse_dmy(F.col(source)))


def parse_price(df: DataFrame, source: str = "price", target: str = "price") -> DataFrame:
    """Price text with thousands commas or quotes -> double."""
    src = F.col(source) if _is_string(df, source) else F.col(source).cast("string")
    return df.withColumn(target, parse_price_text(src))


def default_class(df: DataFrame, value: str, overwrite: bool) -> DataFrame:
    """Constant class (business file) or class default (economy file)."""
    if overwrite or "class" not in df.columns:
        return df.withColumn("class", F.lit(value))
    return df.withColumn("class", F.coalesce(F.col("class"), F.lit(value)))


def standardize_business(df: DataFrame) -> DataFrame:
    date_src = "ggldate" if "ggldate" in df.columns else "date"
    out = parse_dates(df, date_src) if date_src in df.columns else df
    out = parse_price(out) if "price" in out.columns else out
    return default_class(out, "Business", overwrite=True)


def standardize_economy(df: DataFrame) -> DataFrame:
    date_src = "date" if "date" in df.columns else "ggldate"
    out = parse_dates(df, date_src) if date_src in df.columns else df
    out = parse_price(out) if "price" in out.columns else out
    return default_class(out, "Economy", overwrite=False)


def union_fares(*frames: DataFrame) -> DataFrame:
    """Stack fare frames by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------- clean
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates. The hash aggregate removes copies map-side first."""
    return df.dropDuplicates()


def fit_fill_values(df: DataFrame, mode_cols=("airline", "from", "to", "class", "stop"),
                    median_cols=("price", "duration")) -> dict:
    """Fitted fill values: mode (ties -> smallest, none -> 'Unknown') and median per column.

    One value histogram of the columns is written in a single pass; modes and
    medians are read from it. Every column gets a value, because rows cleaned
    later may hold nulls where the fitting rows had none.
    """
    mode_cols = [c for c in mode_cols if c in df.columns]
    median_cols = [c for c in median_cols if c in df.columns]
    if not mode_cols and not median_cols:
        return {}
    hist = materialize(value_histogram(df, mode_cols, median_cols), "fill-histogram")
    fills: dict = {}
    if mode_cols:
        found = modes_from_histogram(hist)
        for c in mode_cols:
            fills[c] = found.get(c, "Unknown")
    if median_cols:
        med = quantiles_from_histogram(hist.where(F.col("column").isin(median_cols)), ["column"], "v",
                                       {"median": 0.5}, groups_bounded=True).collect()
        for r in med:
            fills[r["column"]] = r["median"]
    return fills


def fill_missing(df: DataFrame, fills: dict | None = None,
                 constant_cols=("dep_time", "arr_time"), constant: str = "Unknown") -> DataFrame:
    """Modes for categoricals, medians for numbers, a constant for time labels."""
    fills = dict(fit_fill_values(df) if fills is None else fills)
    for c in constant_cols:
        if c in df.columns:
            fills[c] = constant
    out = df
    for c, v in fills.items():
        if c in out.columns and v is not None:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(out.schema[c].dataType)))
    return out


def clean_price(df: DataFrame, source: str = "price", target: str = "price") -> DataFrame:
    """Keep digits and dots, to number, keep ``> 0``; values below 1000 are x1000.

    For a numeric source the digit filter equals ``abs`` (it only drops the sign),
    and avoids Spark's exponent notation when casting large doubles to text.
    """
    raw = digits_and_dot(F.col(source)) if _is_string(df, source) else F.abs(F.col(source).cast("double"))
    out = df.withColumn(target, raw).where(F.col(target) > 0)
    return out.withColumn(target, F.when(F.col(target) < 1000, F.col(target) * F.lit(1000)).otherwise(F.col(target)))


def clean_time_labels(df: DataFrame, fixes: dict | None = None, cols=("dep_time", "arr_time")) -> DataFrame:
    """P10: unify time slot spellings; other labels unchanged."""
    fixes = fixes or TIME_LABEL_FIXES
    return df.withColumns({c: relabel(F.col(c), fixes) for c in cols if c in df.columns})


def iqr_bounds(df: DataFrame, col: str = "price", k: float = 1.5) -> tuple[float, float] | None:
    """Fitted ``(Q1 - k*IQR, Q3 + k*IQR)`` with linear-interpolated exact quartiles."""
    rows = exact_quantiles(df, col, {"q1": 0.25, "q3": 0.75}).collect()
    if not rows:
        return None
    q1, q3 = rows[0]["q1"], rows[0]["q3"]
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def iqr_filter(df: DataFrame, col: str = "price", k: float = 1.5, bounds=None) -> DataFrame:
    """Keep rows with the value inside the IQR fences (bounds fitted if not given)."""
    if col not in df.columns:
        return df
    bounds = bounds if bounds is not None else iqr_bounds(df, col, k)
    if bounds is None:
        return df.where(F.lit(False))
    lo, hi = bounds
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


class StepCounts:
    """Row counts of the cleaning steps, observed by the jobs that clean anyway (no further pass).

    A step's count is known once a job over its rows has ended; ``table`` waits for the last one, so call
    it after the cleaned table has been written or read to its end. Tasks that Spark runs again after an
    executor is lost report their rows again: counts are for reports, not for decisions.
    """

    def __init__(self):
        self.steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        seen = Observation(f"clean-{step}-{uuid.uuid4().hex[:8]}")
        self.steps.append((step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(position, step, rows_in, rows_out, removed)``, one row per step after the first."""
        counts = [(step, int(seen.get["n"])) for step, seen in self.steps]
        rows = [(i, step, before, n, before - n) for i, ((_, before), (step, n)) in enumerate(zip(counts, counts[1:]), 1)]
        return spark.createDataFrame(rows, "position int, step string, rows_in long, rows_out long, removed long")


def clean_fares(df: DataFrame, price_source: str = "price", persist: bool = True, counts: StepCounts | None = None) -> DataFrame:
    """Duplicates -> missing values -> price -> time labels -> price outliers.

    The table is written to the shared checkpoint folder after de-duplication
    and before the outlier fences are fitted, so each fitted statistic and the filters read the same
    materialised rows (and a lost executor does not re-run the earlier steps). With ``counts``, the
    rows that each step removes are counted by the jobs that run here and by the one that reads the result.
    """
    watch = (lambda frame, step: frame) if counts is None else counts.watch
    out = watch(drop_duplicates(watch(df, "read")), "duplicates")
    if persist:
        out = materialize(out, "deduplicated")
    out = fill_missing(out)
    out = watch(clean_price(out, source=price_source, target="price"), "price")
    out = clean_time_labels(out)
    if persist:
        out = materialize(out, "cleaned")
    return watch(iqr_filter(out, "price"), "outliers")
