"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelens.llm.scratch import write_once
from farelens.session import delete_folder

TASK_LINKS = 500_000        # links that a task contracts at once


def _contract(batches):
    """Links of a task as stars around the smallest node of each of its groups, in bounded parts."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = root[r]
            x = r
        return x

    def flush():
        stars = [(x, find(x)) for x in root]
        root.clear()
        stars = [(x, r) for x, r in stars if x != r]
        return pa.record_batch([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())],
                               ["u", "v"])

    n = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= TASK_LINKS:
            yield flush()
            n = 0
    if root:
        yield flush()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each linked node: ``(node, component)``.

    Each round points every neighbour of a node at the node's smallest neighbour, first from
    larger neighbours and then from smaller ones; the links stay linear in number and their
    depth shrinks geometrically. Groups are reduced by a ``min`` (partial aggregation) and a
    join that Spark may split, so a hub with a third of all links is never held by one task.
    Every round is written to the shared folder, and the round before it is deleted; before the
    first round each task contracts the links that it reads. Null ends and self links are ignored; an empty
    table gives an empty result. Nodes without links are not listed.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = edges.where("u is not null and v is not null and u <> v")
    spark = links.sparkSession
    edges = write_once(edges.mapInArrow(_contract, "u long, v long").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(small_least.select("u", F.col("m").alias("v"))).distinct())
        done, edges = edges.inputFiles(), write_once(small, "links")
        for folder in {f.rpartition("/")[0] for f in done}:
            delete_folder(spark, folder)
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"),
                        F.countDistinct("u").alias("d")).first()
        state = (row["n"], row["h"])
        if state == before or row["n"] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct()
