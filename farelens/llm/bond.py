"""Hard-negative mining by a vertical scan with branch-and-bound over dimensions.

Candidates are kept in blocks of ``BLOCK`` rows, one column per dimension. For an anchor the columns are
read in descending magnitude of the anchor's own components. After every few dimensions the smallest
and the largest contribution that the unread columns can still add (from the minimum and maximum of
each column) bound the score of every candidate, and the bitmap of candidates shrinks to those that can
still matter: for the positives, the best rows of the anchor's label; for the negatives, the rows that
may lie in a score window and among its best. What is left after the last dimension has exact scores.

Scale: rows equal in label and vector are one class and keep their smallest ids only, so a vector that
a third of all rows share is scored once. Anchors and candidates meet in a grid: anchors in groups of
``ANCHORS``, candidates in groups of ``CANDIDATES``, one cell for each pair; a cell streams its blocks past
its anchors, holds short lists only, and hands on those alone. Lists of the cells of an anchor are
merged by windows that Spark limits before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.llm.scratch import shuffle_partitions, write_once

BLOCK = 4096
ANCHORS = 512
CANDIDATES = 1 << 18
STEP = 8               # dimensions read between two prunings
LARGEST = 1 << 26      # components beyond this (x beyond 2**18) saturate, so that sums fit a long
HOT = 100_000          # anchors of one class from which its result rows are spread

_ROWS = "id long, label long, dims int, vector binary"


def quantised(vectors: DataFrame, id_col: str, label: Column, vec_col: str, scale: int = 256) -> DataFrame:
    """``id, label, dims, vector``: rows that take part, components ``floor(scale * x)`` as packed int32."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("vector", pa.binary())])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().cast(pa.float64())
            x = np.where(flat.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), np.nan)
            finite = np.concatenate([[0], np.cumsum(np.isfinite(x))])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            ok = (lengths > 0) & (finite[ends] - finite[starts] == lengths)
            ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.nan_to_num(np.clip(np.floor(scale * x), -LARGEST, LARGEST)).astype("<i4")
            at = np.flatnonzero(ok)
            take = pa.array(at)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(lengths[at].astype(np.int32)),
                                   pa.array([q[starts[i]:ends[i]].tobytes() for i in at.tolist()], pa.binary())], schema=schema)

    return vectors.select(F.col(f"`{id_col}`").cast("long"), label.cast("long"), F.col(f"`{vec_col}`")).mapInArrow(run, _ROWS)


class Block:
    """Rows of one length: a column per dimension, with the minimum and maximum of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels = ids, labels
        largest = int(np.abs(rows).max(initial=0))
        # products and sums of whole numbers are exact in doubles below 2**53
        self.kind = np.float64 if largest * largest * rows.shape[1] < 1 << 52 else np.int64
        self.largest = largest
        self.columns = np.ascontiguousarray(rows.T.astype(self.kind))
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, start: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """(row, exact score) of the rows of ``start`` that ``prune(low, high)``, a mask, never drops."""
        if self.kind is np.float64 and int(np.abs(anchor).max(initial=0)) * self.largest * len(anchor) >= 1 << 52:
            columns, low, high = self.columns.astype(np.int64), self.low.astype(np.int64), self.high.astype(np.int64)
        else:
            columns, low, high = self.columns, self.low, self.high
        q = anchor.astype(columns.dtype)
        order = np.argsort(-np.abs(q), kind="stable")
        ends = q * low, q * high
        least = np.append(np.cumsum(np.minimum(*ends)[order][::-1])[::-1], 0)
        most = np.append(np.cumsum(np.maximum(*ends)[order][::-1])[::-1], 0)
        alive, score = start, np.zeros(len(start), columns.dtype)
        for a in range(0, len(order), STEP):
            if not len(alive):
                break
            dims = order[a:a + STEP]
            part = columns[dims] if len(alive) == columns.shape[1] else columns[dims[:, None], alive]
            score = score + q[dims] @ part
            done = min(a + STEP, len(order))
            keep = prune(score + least[done], score + most[done])
            if not keep.all():
                alive, score = alive[keep], score[keep]
        return alive, score.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, -scores))[:k]
    return scores[by], ids[by]


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


class Nearest:
    """Short list of an anchor: the ``k`` best rows of its own label."""

    def __init__(self, label: int, k: int):
        self.label, self.k = label, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, labels: np.ndarray) -> np.ndarray:
        return np.flatnonzero(labels == self.label)

    def prune(self, low, high):
        floor = _kth(low, self.k)
        if len(self.scores) == self.k:
            floor = self.scores[-1] if floor is None else max(floor, self.scores[-1])
        return np.ones(len(low), bool) if floor is None else high >= floor

    def add(self, scores, ids):
        self.scores, self.ids = _best(np.append(self.scores, scores), np.append(self.ids, ids), self.k)

    def found(self):
        return self.scores, self.ids


class Windows:
    """Short lists of an anchor: the ``k`` best rows of other labels inside each score window."""

    def __init__(self, label: int, k: int, windows: list[tuple[int, int]]):
        self.label, self.k = label, k
        self.windows = [w for w in windows if w[0] <= w[1]]
        self.lists = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.windows]

    def rows(self, labels: np.ndarray) -> np.ndarray:
        return np.flatnonzero(labels != self.label) if self.windows else np.zeros(0, np.int64)

    def prune(self, low, high):
        keep = np.zeros(len(low), bool)
        for (lo, hi), (scores, _) in zip(self.windows, self.lists):
            if len(scores) == self.k:
                lo = max(lo, scores[-1])
            may = (high >= lo) & (low <= hi)
            # rows sure to lie in the window raise what its others must be able to reach
            floor = _kth(low[may & (low >= lo) & (high <= hi)], self.k)
            keep |= may if floor is None else may & (high >= floor)
        return keep

    def add(self, scores, ids):
        for i, ((lo, hi), (s, n)) in enumerate(zip(self.windows, self.lists)):
            at = (scores >= lo) & (scores <= hi)
            if at.any():
                self.lists[i] = _best(np.append(s, scores[at]), np.append(n, ids[at]), self.k)

    def found(self):
        if not self.lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores, ids = np.concatenate([s for s, _ in self.lists]), np.concatenate([n for _, n in self.lists])
        ids, first = np.unique(ids, return_index=True)
        return scores[first], ids


def candidate_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """``block, dims, labels, ids, vectors``: candidates packed ``BLOCK`` at a time, labels together."""
    schema = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("labels", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        held: list[tuple] = []

        def flush():
            ids, labels, vectors = ([r[i] for r in held] for i in (0, 1, 3))
            dims, first = held[0][2], held[0][0]
            held.clear()
            return pa.record_batch([pa.array([first], pa.int64()), pa.array([dims], pa.int32()),
                                    pa.array([np.array(labels, "<i8").tobytes()], pa.binary()),
                                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())],
                                   schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[2] != held[0][2] or len(held) >= BLOCK):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    # as many parts as candidates ask for, or as tasks can share
    dealt = rows.select("id", "label", "dims", "vector").repartition(parts, "id").sortWithinPartitions("dims", "label", "id")
    return dealt.mapInArrow(run, "block long, dims int, labels binary, ids binary, vectors binary")


def _scan_cells(blocks: DataFrame, asked: DataFrame, a_groups: int, c_groups: int, make) -> DataFrame:
    """``key, score, id``: what the short list of every asked row holds after each cell of the grid.

    ``asked`` has ``key, label, dims, vector, windows``; ``make(label, windows)`` gives its empty short list.
    """
    schema = pa.schema([("key", pa.string()), ("score", pa.int64()), ("id", pa.int64())])
    empty = F.lit(None).cast("binary")
    points = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(a_groups - 1))).alias("a"),
                           F.pmod(F.xxhash64("block"), F.lit(c_groups)).cast("int").alias("c"), "dims", F.lit(1).alias("kind"),
                           F.col("block").alias("at"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("label"),
                           "vectors", "labels", "ids", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("windows"))
    anchors = asked.select(F.pmod(F.xxhash64("key"), F.lit(a_groups)).cast("int").alias("a"),
                           F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))).alias("c"), "dims", F.lit(0).alias("kind"),
                           F.xxhash64("key").alias("at"), "key", "label", F.col("vector").alias("vectors"),
                           empty.alias("labels"), empty.alias("ids"), "windows")

    def run(batches):
        cell, lists = None, []

        def answer():
            keys, scores, ids = [], [], []
            for key, _, found in lists:
                s, n = found.found()
                keys += [key] * len(s)
                scores.append(s)
                ids.append(n)
            lists.clear()
            if keys:
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(ids))],
                                      schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                a, c, dims, kind, _, key, label, vectors, labels, ids, windows = (col[i].as_py() for col in batch.columns)
                if (a, c, dims) != cell:
                    yield from answer()
                    cell = (a, c, dims)
                rows = np.frombuffer(vectors, "<i4").reshape(-1, dims)
                if kind == 0:
                    lists.append((key, rows[0].astype(np.int64), make(label, windows)))
                    continue
                if not lists:
                    continue
                block = Block(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), rows)
                for _, anchor, found in lists:
                    start = found.rows(block.labels)
                    if len(start):
                        alive, score = block.scan(anchor, start, found.prune)
                        if len(alive):
                            found.add(score, block.ids[alive])
        yield from answer()

    cells = anchors.unionByName(points).repartition(a_groups * c_groups, "a", "c").sortWithinPartitions("a", "c", "dims", "kind", "at")
    return cells.mapInArrow(run, "key string, score long, id long")


def hard_negatives(vectors: DataFrame, anchor_rows: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label: Column | None = None, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
                   scale: int = 256, hot: int = HOT) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor_rows`` is a condition on ``id``. Scores are integer inner products of ``floor(scale * x)``; higher
    come first, ties by the smaller id. An anchor's positives are its first other rows of the same
    ``label``; for each positive, the negatives are the first rows of other labels with
    ``window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score``.

    Defined cases: rows whose id, label or vector is null, whose vector is empty or holds a null or
    non-finite component take no part; of rows that share an id the least by (label, vector) takes part,
    so repeated rows count once; vectors are compared with vectors of their own length; components
    beyond ``LARGEST`` saturate; an anchor without positives, or a positive without rows in its window,
    gives no row; an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = quantised(vectors, id_col, label, vec_col, scale)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "dims", "vector")).alias("r")).select("id", "r.*")
    one = write_once(one.withColumn("key", F.md5(F.concat(F.col("label").cast("string"), F.lit("|"), F.hex("vector")))), "bond-rows")
    # of rows equal in label and vector the smallest ids can be listed, and no others
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    useful = write_once(one.withColumn("n", place).where(F.col("n") <= max(positives + 1, negatives)).drop("n"), "bond-candidates")
    anchors = one.where(anchor_rows).select("id", "key", "label", "dims", "vector")
    asked = write_once(anchors.groupBy("key").agg(F.first("label").alias("label"), F.first("dims").alias("dims"),
                                                  F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n")), "bond-anchors")
    n_rows, n_asked = useful.count(), asked.count()
    a_groups = max(1, -(-n_asked // ANCHORS))
    c_groups = max(1, -(-n_rows // CANDIDATES), min(-(-n_rows // 1024), -(-shuffle_partitions(spark) // a_groups)))
    blocks = write_once(candidate_blocks(useful, c_groups), "bond-blocks")
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")

    k = positives + 1                                    # one of them may be the anchor itself
    near = _scan_cells(blocks, asked.select("key", "label", "dims", "vector", none.alias("windows")), a_groups, c_groups,
                       lambda own, _: Nearest(own, k))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    best = write_once(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k), "bond-positives")
    lo, hi = (F.expr(f"cast(ceil({window[0]} * cast(score as decimal(20)) / 100) as bigint)"),
              F.expr(f"cast(floor({window[1]} * cast(score as decimal(20)) / 100) as bigint)"))
    windows = best.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(lo.alias("lo"), hi.alias("hi")))).alias("windows"))
    far = _scan_cells(blocks, asked.select("key", "label", "dims", "vector").join(windows, "key"), a_groups, c_groups,
                      lambda own, given: Windows(own, negatives, [(w["lo"], w["hi"]) for w in given]))
    pairs = best.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")).join(
        far.select("key", F.col("score").alias("negative_score"), F.col("id").alias("negative_id")), "key")
    pairs = pairs.where("negative_score between lo and hi")
    rank = F.row_number().over(Window.partitionBy("key", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    listed = pairs.withColumn("rank", rank).where(F.col("rank") <= negatives).groupBy("key", "positive_id", "positive_score").agg(
        F.sort_array(F.collect_list(F.struct("rank", "negative_id", "negative_score"))).alias("found"))
    # every positive with its (maybe empty) list, in one row per class of anchors
    lists = best.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        listed, ["key", "positive_id", "positive_score"], "left").groupBy("key").agg(
        F.collect_list(F.struct(F.col("positive_score"), F.col("positive_id"), F.col("found"))).alias("positives"))
    # classes with very many anchors are spread; there are at most n_anchors / hot of them
    crowded = F.broadcast(asked.where(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("salts")))
    one_of = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    left = anchors.select("id", "key").join(crowded, "key", "left").select("id", "key", one_of.alias("salt"))
    right = lists.join(crowded, "key", "left").select("key", "positives", F.explode(F.sequence(
        F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    # by falling score, ties by the smaller id; the anchor itself is none of its positives
    mine = F.slice(F.array_sort(F.filter("positives", lambda p: p["positive_id"] != F.col("id")), lambda x, y: F.when(
        (x["positive_score"] > y["positive_score"]) | ((x["positive_score"] == y["positive_score"]) & (x["positive_id"] < y["positive_id"])), -1)
        .when(x["positive_id"] == y["positive_id"], 0).otherwise(1)), 1, positives)
    out = left.join(right, ["key", "salt"]).select(F.col("id").alias("anchor_id"), F.explode(mine).alias("p"))
    out = out.select("anchor_id", "p.positive_id", "p.positive_score", F.explode("p.found").alias("f"))
    return out.select("anchor_id", "positive_id", "f.rank", "f.negative_id", "positive_score", "f.negative_score")
