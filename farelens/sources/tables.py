"""Fare-shaped views over the driver tables (see FIXTURES.md §3).

The driver tables are a star schema; a *fare* is one line item, priced by its
extended price, carried by the part brand, flown between the supplier's and
the customer's nation. Each builder selects only the columns it needs before
joining, so the parquet scans read a pruned schema.

Join strategy: ``customer`` is joined to ``orders``, which has fewer and narrower rows, before both meet
``lineitem`` in a sort-merge join on the order key. ``part`` and ``customer`` are joined without hints:
Catalyst and AQE broadcast them when their runtime size is below the threshold and shuffle otherwise.
``supplier`` is broadcast while its counted rows stay under 64 MB. ``nation`` is a fixed dimension
(one row per nation) and is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelens.functions.lookups import lookup

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# --- fixed values: fixture label mappings (driver codes -> raw slot labels) --
DEP_SLOT_OF_PRIORITY = {
    "1-URGENT": "Early_Morning",
    "2-HIGH": "Morning",
    "3-MEDIUM": "Afternoon",
    "4-NOT SPECIFIED": "Evening",
    "5-LOW": "Late_Night",
}
ARR_SLOT_OF_SEGMENT = {
    "AUTOMOBILE": "Morning",
    "BUILDING": "Afternoon",
    "FURNITURE": "Evening",
    "HOUSEHOLD": "Night",
    "MACHINERY": "Early_Morning",
}

FARE_COLUMNS = ["fare_key", "price", "airline", "flight", "from", "to", "dep_time", "arr_time",
                "class", "stop", "duration", "days_left", "date"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows when a scan yields fewer tasks than the cluster has cores.

    A file written as one large row group is read by a single task; the per-row
    work after it (joins, features) would then run on one core. On large inputs
    the scan already has more splits than cores and nothing is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, source: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint when the rows of ``source`` (counted in the file footers), of which it
    holds at most as many, stay under ``max_bytes`` at the width of its types."""
    from farelens.operators.stats import row_width
    return F.broadcast(df) if source.count() * row_width(df) <= max_bytes else df


def _fare_base(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                      "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"))
    od = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    su = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    cu = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    pa = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    ns = F.broadcast(nation.withColumnsRenamed({"n_nationkey": "ns_key", "n_name": "from"}))
    nc = F.broadcast(nation.withColumnsRenamed({"n_nationkey": "nc_key", "n_name": "to"}))
    suppliers = small_side(su.join(ns, F.col("s_nationkey") == F.col("ns_key")).select("s_suppkey", "from"), su)
    customers = cu.join(nc, F.col("c_nationkey") == F.col("nc_key")).select("c_custkey", "to", "c_mktsegment")
    trips = od.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", "o_orderpriority", "to", "c_mktsegment")
    return (li.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(pa, F.col("l_partkey") == F.col("p_partkey"))
            .join(trips, li.l_orderkey == F.col("o_orderkey")))


def _fare_columns(ship_date: Column) -> dict[str, Column]:
    return {
        "fare_key": F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                                ship_date.cast("string")),
        "price": F.col("l_extendedprice"),
        "airline": F.col("p_brand"),
        "flight": F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")),
        "from": F.col("from"),
        "to": F.col("to"),
        "dep_time": lookup(F.col("o_orderpriority"), DEP_SLOT_OF_PRIORITY),
        "arr_time": lookup(F.col("c_mktsegment"), ARR_SLOT_OF_SEGMENT),
        "class": F.when(F.col("l_returnflag") == "R", "Business").otherwise("Economy"),
        "stop": F.when(F.col("l_linestatus") == "F", "zero").otherwise("one"),
        "duration": F.col("l_quantity") / F.lit(4.0),
        "days_left": F.abs(F.datediff(ship_date, F.to_date("o_orderdate"))) % 100,
        "date": ship_date,
        "fare_value": F.col("p_retailprice") * F.col("l_quantity"),
    }


def fares(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The fare table: one row per line item, columns of FIXTURES.md §3.

    ``extra`` may name ``fare_value``, the label of the training queries: retail price times
    quantity, which the features can explain (``price`` is independent of them).
    """
    ship = F.to_date("l_shipdate")
    cols = _fare_columns(ship)
    return _fare_base(spark, sf_dir).select(*[cols[c].alias(c) for c in (*FARE_COLUMNS, *extra)])


def fares_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fares`` with nulls, price text and whole-row duplicates, for the cleaning operators."""
    ship = F.to_date("l_shipdate")
    cols = _fare_columns(ship)
    ln = F.col("l_linenumber")
    cols["airline"] = F.when(ln == 7, F.lit(None).cast("string")).otherwise(cols["airline"])
    cols["duration"] = F.when(ln == 6, F.lit(None).cast("double")).otherwise(cols["duration"])
    cols["dep_time"] = F.when(ln == 5, F.lit(None).cast("string")).otherwise(cols["dep_time"])
    cols["price_text"] = F.concat(F.lit('"'), F.format_number(F.col("l_extendedprice"), 2), F.lit('"'))
    names = FARE_COLUMNS + ["price_text"]
    # Rows of line 1 appear twice. One generator in the same pass over the join,
    # instead of a union that would run the seven-way join a second time.
    copies = F.explode(F.when(ln == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (_fare_base(spark, sf_dir)
            .select(*[cols[c].alias(c) for c in names], copies.alias("_copy"))
            .drop("_copy"))


def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cost index: one row per order day, ``max(o_totalprice) / 1000``.

    Grouping by day does a partial (map-side) aggregation, so the shuffle is
    at most one row per day per map task.
    """
    od = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    return (od.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg((F.max("o_totalprice") / F.lit(1000.0)).alias("index_price")))


def fuel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily index in the shape of the reference fuel series."""
    from farelens.constants import LITRE_FACTOR
    return daily_index(spark, sf_dir).select(
        "date",
        F.col("index_price").alias("fuel_price_usd_per_barrel"),
        (F.col("index_price") * F.lit(LITRE_FACTOR)).alias("fuel_price_inr_per_liter"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fares with a label ``y`` and three fixed predictions (for metrics and ensembles)."""
    ship = F.to_date("l_shipdate")
    cols = _fare_columns(ship)
    b = _fare_base(spark, sf_dir)
    return b.select(
        cols["fare_key"].alias("fare_key"),
        cols["from"].alias("from"), cols["to"].alias("to"),
        (F.col("p_retailprice") * F.col("l_quantity")).alias("y"),
        F.col("l_extendedprice").alias("pred_linear"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("pred_forest"),
        (F.col("l_extendedprice") * (F.lit(1) + F.col("l_discount"))).alias("pred_boosted"),
    )


def _file_columns(ship):
    cols = _fare_columns(ship)
    ln = F.col("l_linenumber")
    bad = ln == 3  # malformed day-month text (31 February) on one line in eight
    dmy = F.when(bad, F.concat(F.lit("31-02-"), F.year(ship).cast("string"))).otherwise(
        F.date_format(ship, "dd-MM-yyyy"))
    return cols, dmy


def clean_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fares in the layout of the clean fare file (city/time names, numeric price)."""
    cols = _fare_columns(F.to_date("l_shipdate"))
    return _fare_base(spark, sf_dir).select(
        cols["fare_key"].alias("fare_key"), cols["airline"].alias("airline"), cols["flight"].alias("flight"),
        cols["from"].alias("source_city"), cols["to"].alias("destination_city"),
        cols["dep_time"].alias("departure_time"), cols["arr_time"].alias("arrival_time"),
        cols["stop"].alias("stops"), cols["class"].alias("class"), cols["duration"].alias("duration"),
        cols["days_left"].alias("days_left"), cols["price"].alias("price"))


def business_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business-cabin fares in the layout of the business file (text date and price)."""
    from farelens.functions.text import format_duration
    ship = F.to_date("l_shipdate")
    cols, dmy = _file_columns(ship)
    return _fare_base(spark, sf_dir).where(F.col("l_returnflag") == "R").select(
        cols["fare_key"].alias("fare_key"), cols["airline"].alias("airline"),
        F.substring(F.col("p_brand"), 1, 2).alias("ch_code"), F.col("p_size").cast("string").alias("num_code"),
        cols["from"].alias("from"), cols["to"].alias("to"), cols["stop"].alias("stop"),
        cols["dep_time"].alias("dep_time"), cols["arr_time"].alias("arr_time"),
        format_duration(cols["duration"]).alias("time_taken"), dmy.alias("ggldate"),
        F.concat(F.lit('"'), F.format_number(F.col("l_extendedprice"), 2), F.lit('"')).alias("price"))


def economy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other fares in the layout of the economy file (text ``date`` and price with commas)."""
    from farelens.functions.text import format_duration
    ship = F.to_date("l_shipdate")
    cols, dmy = _file_columns(ship)
    return _fare_base(spark, sf_dir).where(F.col("l_returnflag") != "R").select(
        cols["fare_key"].alias("fare_key"), cols["airline"].alias("airline"),
        F.substring(F.col("p_brand"), 1, 2).alias("ch_code"), F.col("p_size").cast("string").alias("num_code"),
        cols["from"].alias("from"), cols["to"].alias("to"), cols["stop"].alias("stop"),
        cols["dep_time"].alias("dep_time"), cols["arr_time"].alias("arr_time"),
        format_duration(cols["duration"]).alias("time_taken"), dmy.alias("date"),
        F.format_number(F.col("l_extendedprice"), 2).alias("price"))
