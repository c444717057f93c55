"""Exact ranks within ordered groups, and bounded runs of sorted rows, for the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.llm.scratch import shuffle_partitions, write_once

_INSIDE = (1 << 33) - 1        # monotonically_increasing_id keeps the place in its partition in 33 bits


def ranked(rows: DataFrame, group: str, order: list[str], extra: DataFrame | None = None) -> DataFrame:
    """``rows`` plus ``rank`` (0, 1, ... in its group, by ``order``, nulls first) and ``group_size``.

    ``rows`` should be a written, narrow table: it is sampled once to choose the ranges. The sort is
    over (group, order), so a group that holds a third of all rows spreads over many tasks. Ranks
    come from the counts of (partition, group) runs of the written result, at most partitions plus
    groups many; rows are joined with those runs, not with their groups. ``extra`` (one row per
    group, first column the group) is joined to the runs, so its columns reach the rows the same way.
    Rows equal in group and order are interchangeable. ``group`` must not be null.
    """
    n = shuffle_partitions(rows.sparkSession)
    placed = write_once(rows.repartitionByRange(n, F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order])
                        .sortWithinPartitions(F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order])
                        .withColumns({"_part": F.spark_partition_id(),
                                      "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_INSIDE))}), "ranked")
    runs = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", group, (before - F.col("_first")).alias("_base"), F.sum("_n").over(whole).alias("group_size"))
    if extra is not None:
        runs = runs.join(extra, group, "left")
    return placed.join(runs, ["_part", group]).withColumn("rank", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def sorted_runs(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Rows of equal ``keys`` brought together and sorted, for ``groups`` below."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows of equal leading ``n_keys`` columns; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = None
        for i in range(n_keys):
            column = batch.column(i)
            moved = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True)
            cut = moved if cut is None else pc.or_(cut, moved)
        edges = [0, *(i + 1 for i, x in enumerate(cut.to_pylist()) if x), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(batch.column(i)[a].as_py() for i in range(n_keys))
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
