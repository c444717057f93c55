"""Distributed exact order statistics, modes and size-checked broadcasts.

Exact quantiles
---------------
``percentile`` keeps every value of a group in one aggregation buffer, which
does not scale when one group holds a large share of the rows. Here a
quantile is found from ranks instead:

1. aggregate to a value histogram ``(group, value, cnt)`` (partial
   aggregation folds repeated values before the shuffle);
2. range-partition the histogram by ``(group, value)`` and write it with the
   partition number: a large group is spread over many partitions, and all
   later reads see the same partitions (range bounds come from a sample that
   may differ from run to run);
3. cumulative counts inside each partition (window over ``(pid, group)``)
   plus the counts of the group in earlier partitions (a table of at most
   ``partitions + groups`` rows) give every value its rank interval;
4. the values at ranks ``floor/ceil((n-1)q)`` are picked by a filter and
   interpolated linearly, the same rule as a continuous quantile.

No step gathers a group in one task; every shuffle is bounded by a range
partition or by the histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_PID = "_pid"


def shuffle_partitions(df: DataFrame, n: int | None = None) -> int:
    """``n``, or the session's number of shuffle partitions."""
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_intervals(hist: DataFrame, by: list[str], value: str, weight: str = "cnt",
                   num_partitions: int | None = None, groups_bounded: bool = False) -> DataFrame:
    """Add ``_lo``/``_hi`` (0-based rank interval of each histogram row) and ``_n``.

    ``hist`` has one row per ``(by..., value)`` with a positive ``weight``. Its plan runs once:
    the range-partitioned rows are written with their partition number. ``groups_bounded``
    says that the number of groups does not grow with the data; only then are the offsets
    (``partitions + groups`` rows at most) broadcast by hint.
    """
    n = shuffle_partitions(hist, num_partitions)
    keys = [*by, value]
    ranged = materialize(
        hist.select(*keys, weight).repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys])
        .withColumn(_PID, F.spark_partition_id()), "ranged-histogram")
    w_in = Window.partitionBy(_PID, *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("_cum", F.sum(weight).over(w_in))
    per_part = ranged.groupBy(_PID, *by).agg(F.sum(weight).alias("_tot"))
    w_prev = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    offsets = per_part.select(
        F.col(_PID).alias("_opid"), *[F.col(k).alias(f"_o_{k}") for k in by],
        F.coalesce(F.sum("_tot").over(w_prev), F.lit(0)).alias("_off"),
        F.sum("_tot").over(w_all).alias("_n"),
    )
    if groups_bounded:
        offsets = F.broadcast(offsets)
    cond = F.col(_PID) == F.col("_opid")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = inside.join(offsets, cond).select(*keys, weight, "_off", "_n", "_cum")
    hi = F.col("_off") + F.col("_cum") - F.lit(1)
    return joined.select(*by, value, weight, (hi - F.col(weight) + F.lit(1)).alias("_lo"), hi.alias("_hi"), "_n")


def exact_quantiles(df: DataFrame, value: str | Column, probs: dict[str, float], by: list[str] | None = None,
                    num_partitions: int | None = None, groups_bounded: bool = False) -> DataFrame:
    """One row per group with a column per named probability (continuous quantile).

    Nulls and NaNs are ignored; a group without values yields no row. The
    histogram is written once to the shared checkpoint folder before ranking,
    because the range sample and the partitioning both read it.
    """
    by = list(by or [])
    v = value if isinstance(value, Column) else F.col(value)
    base = df.select(*by, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    hist = materialize(base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("cnt")), "value-histogram")
    ranked = rank_intervals(hist, by, "_v", num_partitions=num_partitions, groups_bounded=groups_bounded)
    return _pick_quantiles(ranked, by, probs)


def _pick_quantiles(ranked: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Values at ranks floor/ceil((n-1)q), interpolated; ``ranked`` from ``rank_intervals`` on ``_v``."""
    aggs = [F.max("_n").alias("_n")]
    for name, q in probs.items():
        rn = (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(q))
        frn, crn = F.floor(rn), F.ceil(rn)
        aggs.append(F.max(F.when((F.col("_lo") <= frn) & (frn <= F.col("_hi")), F.col("_v"))).alias(f"_f_{name}"))
        aggs.append(F.max(F.when((F.col("_lo") <= crn) & (crn <= F.col("_hi")), F.col("_v"))).alias(f"_c_{name}"))
    # Only the rows holding one of the wanted ranks reach the final aggregate.
    wanted = None
    for q in probs.values():
        rn = (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(q))
        for r in (F.floor(rn), F.ceil(rn)):
            c = (F.col("_lo") <= r) & (r <= F.col("_hi"))
            wanted = c if wanted is None else (wanted | c)
    out = ranked.where(wanted).groupBy(*by).agg(*aggs)
    cols = []
    for name, q in probs.items():
        rn = (F.col("_n") - F.lit(1)).cast("double") * F.lit(float(q))
        lo, hi = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        cols.append(F.when(F.floor(rn) == F.ceil(rn), lo)
                    .otherwise(lo + (hi - lo) * (rn - F.floor(rn))).alias(name))
    return out.select(*by, *cols)


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float],
                     num_partitions: int | None = None) -> DataFrame:
    """Quantiles of many numeric columns in one job: ``(column, <prob names>...)``."""
    if not columns:
        raise ValueError("no columns")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("kv")
    ).select("kv.column", "kv.v")
    return exact_quantiles(long, "v", probs, by=["column"], num_partitions=num_partitions, groups_bounded=True)


def fit_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """Collect the (small, one row per column) quantile table as fitted parameters."""
    rows = column_quantiles(df, columns, probs).collect()
    return {r["column"]: {k: r[k] for k in probs} for r in rows}


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value per column, ties -> smallest: ``(column, mode)``.

    Counting ``(column, value)`` pairs aggregates partially on the map side, so a
    value holding a third of all rows costs one row per map task.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("kv")
    ).select("kv.column", "kv.v").where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("b"))
    return best.select("column", F.col("b.v").alias("mode"))


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet (zstd: about a third smaller than the default) under the shared checkpoint folder (or at ``path``) and read it back.

    Cuts the lineage (a lost executor recomputes from the written files, not
    from the source tables) and computes ``df`` exactly once; an eager RDD
    checkpoint of an unpersisted plan would compute it twice.
    """
    from farelens.session import scratch_path
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded_broadcast(small: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``small`` only when it is small in memory; otherwise return it as is.

    The table is written to the shared checkpoint folder first (one job, cuts
    its lineage so a lost executor does not recompute it). Files are compressed, so the size that
    decides is the larger of theirs and of the rows at the width of their types.
    Beyond ``max_bytes`` the join stays a shuffle join and
    AQE's skew handling splits hot keys of the large side.
    """
    saved = materialize(small, "small")
    return F.broadcast(saved) if max(written_bytes(saved), row_bytes(saved)) <= max_bytes else saved


def code_boundary(df: DataFrame) -> DataFrame:
    """``df`` as it is; what follows compiles to methods of its own.

    Operators in a row compile to one method, and the JVM leaves methods over 8,000 bytes interpreted, which makes
    projections of many columns several times slower. ``coalesce`` to more partitions than there are moves no row.
    """
    return df.coalesce(1_000_000)


def row_width(df: DataFrame) -> int:
    """Default width of a row's types, and its header."""
    return df._jdf.schema().defaultSize() + 8


def row_bytes(df: DataFrame) -> int:
    """Rows (from the file footers) times the default width of the column types."""
    return df.count() * row_width(df)


def written_bytes(df: DataFrame) -> int:
    """Total size of the files behind a DataFrame that was read from files."""
    sc = df.sparkSession.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        path = sc._jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def value_histogram(df: DataFrame, string_cols=(), numeric_cols=(), null_label: str | None = None) -> DataFrame:
    """One pass: ``(column, s, v, cnt)`` counts of every value of many columns.

    ``s`` holds string values (``null_label`` stands in for nulls when given,
    else nulls are dropped), ``v`` numeric values (nulls kept as ``v = null``
    so null counts come from the same table). Strings and numbers are counted in an aggregate of their
    own (the scan of each reads its columns only), keyed by the column's position and the value: keys of
    fixed width are several times faster to fold than the column's name and a row of both kinds. Partial
    aggregation folds repeated values map-side, so the shuffle is bounded by distinct values.
    """
    out = None
    for cols, kind in ((list(string_cols), "string"), (list(numeric_cols), "double")):
        if not cols:
            continue
        values = [F.col(c).cast(kind) for c in cols]
        if kind == "string" and null_label is not None:
            values = [F.coalesce(v, F.lit(null_label)) for v in values]
        long = df.select(F.posexplode(F.array(*values)).alias("at", "x"))
        if kind == "string" and null_label is None:
            long = long.where(F.col("x").isNotNull())
        counts = long.groupBy("at", "x").agg(F.count(F.lit(1)).alias("cnt"))
        name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("at") + 1)
        s, v = (F.col("x"), F.lit(None).cast("double")) if kind == "string" else (F.lit(None).cast("string"), F.col("x"))
        part = counts.select(name.alias("column"), s.alias("s"), v.alias("v"), "cnt")
        out = part if out is None else out.unionByName(part)
    return out


def quantiles_from_histogram(hist: DataFrame, by: list[str], value: str, probs: dict[str, float],
                             weight: str = "cnt", groups_bounded: bool = False) -> DataFrame:
    """Continuous quantiles from a weighted histogram ``(by..., value, weight)``."""
    h = hist.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("_v"),
                                                                      F.col(weight).alias("cnt"))
    h = h.groupBy(*by, "_v").agg(F.sum("cnt").alias("cnt"))
    ranked = rank_intervals(h, list(by), "_v", groups_bounded=groups_bounded)
    return _pick_quantiles(ranked, list(by), probs)


def modes_from_histogram(hist: DataFrame) -> dict:
    """Most frequent string per column (ties -> smallest) from ``value_histogram``."""
    best = hist.where(F.col("s").isNotNull()).groupBy("column").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("s").alias("s"))).alias("b"))
    return {r["column"]: r["b"]["s"] for r in best.collect()}
