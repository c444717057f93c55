"""File sources and sinks.

CSV inputs are read with declared schemas (no inference pass over the data)
and permissive parsing; every table written here goes to a folder the caller
names, normally under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from farelens.session import delete_folder

CLEAN_FILE_SCHEMA = T.StructType([
    T.StructField("Unnamed: 0", T.LongType()),
    T.StructField("airline", T.StringType()),
    T.StructField("flight", T.StringType()),
    T.StructField("source_city", T.StringType()),
    T.StructField("departure_time", T.StringType()),
    T.StructField("stops", T.StringType()),
    T.StructField("arrival_time", T.StringType()),
    T.StructField("destination_city", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("days_left", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
])


def _text_schema(date_col: str) -> T.StructType:
    cols = [date_col, "airline", "ch_code", "num_code", "dep_time", "from", "time_taken", "stop", "arr_time", "to",
            "price"]
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


BUSINESS_FILE_SCHEMA = _text_schema("ggldate")
ECONOMY_FILE_SCHEMA = _text_schema("date")
FUEL_FILE_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("fuel_price_usd_per_barrel", T.DoubleType()),
    T.StructField("fuel_price_inr_per_liter", T.DoubleType()),
    T.StructField("price_change_pct", T.DoubleType()),
])
CALENDAR_FILE_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("holiday_name", T.StringType()),
    T.StructField("is_national_holiday", T.BooleanType()),
    T.StructField("holiday_type", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("holiday_impact_score", T.DoubleType()),
])


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_fare_files(spark: SparkSession, folder: str) -> DataFrame:
    """S1 + U1: the three fare files, each standardised, stacked by column name."""
    from farelens.operators import clean as P
    clean = _csv(spark, f"{folder}/Clean_Dataset.csv", CLEAN_FILE_SCHEMA)
    business = _csv(spark, f"{folder}/business.csv", BUSINESS_FILE_SCHEMA)
    economy = _csv(spark, f"{folder}/economy.csv", ECONOMY_FILE_SCHEMA)
    return P.union_fares(P.standardize_clean(clean), P.standardize_business(business),
                         P.standardize_economy(economy))


def read_daily_series(spark: SparkSession, path: str) -> DataFrame:
    """The daily series file with parsed dates."""
    return _csv(spark, path, FUEL_FILE_SCHEMA).withColumn("date", F.to_date("date"))


def read_calendar_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3: every line of the holiday files with its place: ``file``, ``line``, the parsed columns and ``bad``.

    Files are small (some dozens of rows a year), so each is read whole: lines keep the order they have
    in their file, and files come in the order of their names. ``bad`` holds the text of a line that the
    schema cannot parse or that has no valid date (both date text forms are accepted), else null.
    """
    names = [f.name for f in CALENDAR_FILE_SCHEMA.fields]
    lines = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.where((F.col("line") > 0) & (F.trim("text") != ""))          # the first line is the header
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CALENDAR_FILE_SCHEMA.fields) + ", _bad string"
    row = F.from_csv("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("r", row).select("file", "line", "text", "r.*").withColumn("date", F.col("date").try_cast("date"))
    bad = F.when(F.col("_bad").isNotNull() | F.col("date").isNull() | F.col("holiday_name").isNull(), F.col("text"))
    return parsed.select("file", "line", *names, bad.alias("bad"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """S3: the valid rows of the holiday files; ``seq`` numbers them in true file order (file name, then line)."""
    good = read_calendar_rows(spark, path).where("bad is null")
    # a calendar is a lookup table of a few rows per year: one ordered window is its size
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("file", "line"))
    return good.withColumn("seq", order - 1).select("seq", *[f.name for f in CALENDAR_FILE_SCHEMA.fields])


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3: the malformed lines of the holiday files: ``file``, ``line`` and their text."""
    return read_calendar_rows(spark, path).where("bad is not null").select("file", "line", F.col("bad").alias("text"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def publish(df: DataFrame, path: str, *, partition_by: str | None = None, replace: bool = True) -> bool:
    """Write ``df`` beside ``path`` and put it there when it is whole; tells whether this call did.

    Readers see the old table or the new one, never a half-written folder, and a failed write leaves the
    old one. With ``replace`` off the first of several builders wins (the folder is renamed in one
    step, which fails where the target exists); the others drop what they wrote. With ``replace`` on,
    an existing folder is moved aside first, for a moment without a table, and put back if the
    new one cannot be moved in.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    side = f"{path}.building-{uuid.uuid4().hex[:12]}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    try:
        writer.parquet(side)
        if not replace:
            return _rename(spark, side, path)
        aside = f"{path}.replaced-{uuid.uuid4().hex[:12]}"
        moved = _rename(spark, path, aside)
        if _rename(spark, side, path):
            if moved:
                delete_folder(spark, aside)
            return True
        if moved and not path_exists(spark, path):
            _rename(spark, aside, path)
        return False
    finally:
        if path_exists(spark, side):
            delete_folder(spark, side)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step; False where the source is missing or the target exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    a, b = a.getFileSystem(conf).makeQualified(a), b.getFileSystem(conf).makeQualified(b)
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(a.toUri(), conf).rename(a, b, none)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() in ("FileNotFoundException", "FileAlreadyExistsException"):
            return False
        raise


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Use the stored table if it is complete, else build it, publish it and read it back.

    A folder counts as complete only with the committer's ``_SUCCESS`` marker. What an interrupted
    writer of another kind left is replaced; of builders that run at the same time one wins, and
    all read its table.
    """
    done = f"{path.rstrip('/')}/_SUCCESS"
    if not path_exists(spark, done):
        table = build()
        if path_exists(spark, path) and not path_exists(spark, done):
            publish(table, path)
        else:
            publish(table, path, replace=False)
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> DataFrame:
    """Write the table partitioned by split and publish it; readers prune to the split they ask for."""
    publish(df, path, partition_by=split_col)
    return df.sparkSession.read.parquet(path)


LISTS = ("feature_columns", "categorical")      # ordered lists of the fitted state


def save_prep_state(spark: SparkSession, path: str, vocab: DataFrame | None, params: dict) -> None:
    """Fitted state as tables: the vocabulary and one row per (kind, column, values)."""
    if vocab is not None:
        vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    rows = []
    for kind, per_col in params.items():
        if not per_col:
            rows.append((kind, None, None, "list" if isinstance(per_col, (list, tuple)) else "dict"))
        elif isinstance(per_col, dict):
            for col, v in per_col.items():
                vals = [float(x) for x in (v if isinstance(v, (tuple, list)) else [v])] if not isinstance(v, str) else []
                rows.append((kind, col, vals, v if isinstance(v, str) else None))
        else:
            for i, col in enumerate(per_col):
                rows.append((kind, col, [float(i)], None))
    spark.createDataFrame(rows, "kind string, column string, values array<double>, text string") \
        .write.mode("overwrite").parquet(f"{path}/params")


def load_prep_state(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict]:
    """The saved vocabulary (as a DataFrame) and the parameter dictionary."""
    vocab = spark.read.parquet(f"{path}/vocab") if path_exists(spark, f"{path}/vocab") else None
    params: dict = {}
    for r in spark.read.parquet(f"{path}/params").collect():
        if r["column"] is None:
            params[r["kind"]] = [] if r["text"] == "list" else {}
            continue
        if r["kind"] in LISTS:
            params.setdefault(r["kind"], []).append((int(r["values"][0]), r["column"]))
            continue
        v = r["text"] if r["text"] is not None else (tuple(r["values"]) if len(r["values"]) > 1 else r["values"][0])
        params.setdefault(r["kind"], {})[r["column"]] = v
    for kind in LISTS:
        if params.get(kind):
            params[kind] = [c for _, c in sorted(params[kind])]
    return vocab, params


def save_matrix_state(spark: SparkSession, path: str, state: dict) -> None:
    """Everything that ``encode.transform_matrix`` needs, as tables."""
    save_prep_state(spark, path, state["vocab"], {k: state[k] for k in ("scaler", "medians", *LISTS)})


def load_matrix_state(spark: SparkSession, path: str) -> dict:
    """A state for ``encode.transform_matrix``."""
    vocab, params = load_prep_state(spark, path)
    return {"vocab": vocab, **{k: params.get(k, [] if k in LISTS else {}) for k in ("scaler", "medians", *LISTS)}}
