"""Nearest neighbours by cosine with vantage-point trees per shard.

Vectors are scaled to length one, where a larger cosine is a smaller Euclidean distance, a metric.
Each shard of at most about ``shard_size`` distinct vectors becomes one tree: a node keeps a
vantage point and the range of distances of each half of its points. A search skips a half when
the triangle inequality puts it farther than the current k-th distance divided by ``factor``;
factor 1 is exact, larger factors skip more.

Equal vectors are one entry with their smallest ids, so a vector held by a third of all rows is
compared once. The stated queries visit every shard in blocks; each shard returns a short list,
and lists are merged by a window that Spark limits before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from farelens.llm.scratch import write_once
from farelens.llm.vectors import cosines, unit, valid_vectors, vector_key

LEAF = 48
SHARD_SIZE = 8192
QUERY_BLOCK = 512
FACTOR = 1.0
SLACK = 1e-7           # rounding of a distance computed from a cosine near 1
MARGIN = 1e-12         # rounding of a product of unit vectors of up to about 1000 dimensions


class VantagePointTree:
    """Tree over unit vectors; nodes are (vantage, [lo, hi] inside, [lo, hi] outside, children)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self.root = self._build(points, 0, len(points), leaf, rng)
        self.points = points[self.order]

    def _build(self, points, a, b, leaf, rng) -> int:
        at = len(self.nodes)
        own = self.order[a:b]
        if b - a <= leaf:
            self.nodes.append((a, b))
            return at
        vantage = points[own[rng.integers(len(own))]]
        dist = np.sqrt(np.maximum(2.0 - 2.0 * (points[own] @ vantage), 0.0))
        by = np.argsort(dist, kind="stable")
        self.order[a:b] = own[by]
        dist, half = dist[by], (b - a) // 2
        self.nodes.append(None)
        bounds = (dist[0], dist[half - 1], dist[half], dist[-1])
        inside = self._build(points, a, a + half, leaf, rng)
        outside = self._build(points, a + half, b, leaf, rng)
        self.nodes[at] = (vantage, bounds, inside, outside)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, point number) of the ``k`` nearest found, nearest first (-inf, -1 if fewer)."""
        score = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), -1)
        reach = np.full(len(queries), np.inf)

        def visit_leaf(a, b, q):
            cos = queries[q] @ self.points[a:b].T
            s = np.concatenate([score[q], cos], axis=1)
            p = np.concatenate([found[q], np.broadcast_to(np.arange(a, b), cos.shape)], axis=1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            score[q], found[q] = np.take_along_axis(s, top, 1), np.take_along_axis(p, top, 1)
            last = score[q, -1]
            reach[q] = np.where(np.isfinite(last), np.sqrt(np.maximum(2.0 - 2.0 * last, 0.0)) / factor + SLACK, np.inf)

        def distance(q, vantage):
            return np.sqrt(np.maximum(2.0 - 2.0 * (queries[q] @ vantage), 0.0))

        first_leaf = np.full(len(queries), -1)

        def descend(node, q):
            """Nearest leaf of each query: gives every query a first short list."""
            if not len(q):
                return
            if len(self.nodes[node]) == 2:
                first_leaf[q] = node
                visit_leaf(*self.nodes[node], q)
                return
            vantage, (_, hi, lo, _), inside, outside = self.nodes[node]
            near = distance(q, vantage) <= (hi + lo) / 2
            descend(inside, q[near])
            descend(outside, q[~near])

        def sweep(node, q):
            if not len(q):
                return
            if len(self.nodes[node]) == 2:
                q = q[first_leaf[q] != node]
                if len(q):
                    visit_leaf(*self.nodes[node], q)
                return
            vantage, (lo_in, hi_in, lo_out, hi_out), inside, outside = self.nodes[node]
            d = distance(q, vantage)
            for child, lo, hi in ((inside, lo_in, hi_in), (outside, lo_out, hi_out)):
                # by the triangle inequality nothing in the half is nearer than the gap to its range
                sweep(child, q[np.maximum(d - hi, lo - d) <= reach[q]])

        everyone = np.arange(len(queries))
        if len(self.points):
            descend(self.root, everyone)
            sweep(self.root, everyone)
        return score, np.where(found >= 0, self.order[np.maximum(found, 0)], -1)


    def nearest(self, asked: np.ndarray, held: np.ndarray, ids: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, id) of the ``k`` nearest of the vectors ``held`` that the tree was built from.

        ``asked`` and ``held`` are the original vectors. The search over unit vectors bounds the k-th
        score; a second sweep takes everything within rounding of that bound, scores it on the original
        vectors and cuts by score and smaller id, so scaled and near-parallel vectors keep their order.
        """
        queries = unit(asked)
        margin = max(MARGIN, 8 * asked.shape[1] * np.finfo(float).eps)
        bound = self.search(queries, k, factor)[0][:, -1] - margin
        reach = np.where(np.isfinite(bound), np.sqrt(np.maximum(2.0 - 2.0 * bound, 0.0)) / factor + SLACK, np.inf)
        score = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)

        def sweep(node, q):
            if not len(q):
                return
            if len(self.nodes[node]) == 2:
                a, b = self.nodes[node]
                near = queries[q] @ self.points[a:b].T >= bound[q][:, None]
                some = near.any(axis=1)
                q, near = q[some], near[some]
                row, col = np.nonzero(near)
                if len(row):
                    at = self.order[a + col]
                    s, i = np.full(near.shape, -np.inf), np.full(near.shape, np.iinfo(np.int64).max)
                    s[row, col], i[row, col] = cosines(asked[q[row]], held[at]), ids[at]
                    s, i = np.concatenate([score[q], s], axis=1), np.concatenate([found[q], i], axis=1)
                    top = np.lexsort((i, -s), axis=-1)[:, :k]
                    score[q], found[q] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                return
            vantage, (lo_in, hi_in, lo_out, hi_out), inside, outside = self.nodes[node]
            d = np.sqrt(np.maximum(2.0 - 2.0 * (queries[q] @ vantage), 0.0))
            for child, lo, hi in ((inside, lo_in, hi_in), (outside, lo_out, hi_out)):
                sweep(child, q[np.maximum(d - hi, lo - d) <= reach[q]])

        if len(self.points):
            sweep(self.root, np.arange(len(queries)))
        return score, found


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str, smallest: int) -> DataFrame:
    """``(key, rep, dims, vector, ids)``: distinct valid vectors with their smallest ids."""
    schema = pa.schema([("key", pa.binary()), ("vector", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows, vecs = valid_vectors(batch.column(1))
            ids = batch.column(0).to_pylist()
            groups: dict[bytes, tuple[bytes, list[int]]] = {}
            for i, v in zip(rows.tolist(), vecs):
                if ids[i] is not None:
                    groups.setdefault(vector_key(v), ((v + 0.0).tobytes(), []))[1].append(ids[i])
            if groups:
                yield pa.record_batch([pa.array(list(groups), pa.binary()), pa.array([g[0] for g in groups.values()], pa.binary()),
                                       pa.array([sorted(set(g[1]))[:smallest] for g in groups.values()], pa.list_(pa.int64()))],
                                      schema=schema)

    part = vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "key binary, vector binary, ids array<long>")
    # at most `smallest` ids per batch and class reach the merge
    return part.groupBy("key").agg(F.min("vector").alias("vector"), F.slice(F.array_sort(F.array_distinct(
        F.flatten(F.collect_list("ids")))), 1, smallest).alias("ids")).select(
        "key", F.element_at("ids", 1).alias("rep"), F.octet_length("vector").alias("dims"), "vector", "ids")


def _search_shards(classes: DataFrame, queries: DataFrame, shards: int, k: int, factor: float) -> DataFrame:
    """``(query, rep, score)``: the ``k`` nearest classes of each query vector in each shard."""
    schema = pa.schema([("query", pa.binary()), ("rep", pa.int64()), ("score", pa.float64())])
    points = classes.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), "dims", F.lit(0).alias("kind"),
                            F.lit(None).cast("binary").alias("query"), "rep", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dims", F.lit(1).alias("kind"),
                           F.col("key").alias("query"), F.lit(None).cast("long").alias("rep"), "vector")

    def run(batches):
        group = tree = None
        reps, raw, pending, original = [], [], [], None

        def answer():
            nonlocal pending
            todo, pending = pending, []
            if not todo or original is None:
                return None
            q = np.stack([np.frombuffer(v) for _, v in todo])
            score, rep = tree.nearest(q, original, np.array(reps), k, factor)
            row, col = np.nonzero(np.isfinite(score))
            return pa.record_batch([pa.array([todo[i][0] for i in row.tolist()], pa.binary()), pa.array(rep[row, col]),
                                    pa.array(score[row, col])], schema=schema)

        for batch in batches:
            for shard, dims, kind, query, rep, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, dims) != group:
                    if (out := answer()) is not None:
                        yield out
                    group, tree, original, reps, raw = (shard, dims), None, None, [], []
                if kind == 0:
                    reps.append(rep)
                    raw.append(vector)
                    continue
                if tree is None and raw:
                    original = np.stack([np.frombuffer(v) for v in raw])
                    tree, raw = VantagePointTree(unit(original)), []
                pending.append((query, vector))
                if len(pending) >= QUERY_BLOCK and (out := answer()) is not None:
                    yield out
        if (out := answer()) is not None:
            yield out

    rows = points.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "dims", "kind", "rep", "query")
    return rows.mapInArrow(run, "query binary, rep long, score double")


def vp_nearest(vectors: DataFrame, query_rows, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
               factor: float = FACTOR, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query row.

    ``query_rows`` is a condition on ``vectors``. Candidates are all rows but the query's own;
    nearest is the largest cosine in double precision, ties go to the smaller id. With fewer
    candidates, all are returned. ``factor`` 1 searches exactly.

    Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
    and rows with a null id take no part; vectors are compared with vectors of their own length;
    rows equal in id and vector count once, and a row never finds another row of its own id; an
    empty table gives an empty result; other columns are not read.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    classes = write_once(vector_classes(vectors, id_col, vec_col, k + 1), "vector-classes")
    shards = max(1, -(-classes.count() // shard_size))
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.binary())])

    def keys(batches):
        for batch in batches:
            rows, vecs = valid_vectors(batch.column(1))
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([vector_key(v) for v in vecs], pa.binary())],
                                  schema=schema)

    asked = write_once(vectors.where(query_rows).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col))
                       .mapInArrow(keys, "query_id long, key binary").distinct(), "queries")
    wanted = classes.join(asked.select("key").distinct(), "key", "left_semi")
    near = _search_shards(classes, wanted, shards, k + 1, factor)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    lists = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    named = lists.join(classes.select("rep", "ids", F.col("key").alias("found")), "rep").select(
        F.col("query").alias("key"), "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(named, "key").where("vec_id <> query_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
