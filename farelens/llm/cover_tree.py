"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

On unit vectors, a cosine of at least ``c`` is a Euclidean distance of at most
``sqrt(2 - 2 c)``. A cover tree has nested levels with halving radii: every point lies within the
radius of its centre, a centre stays a centre on all finer levels, and centres of one node are
farther apart than the next radius. Two trees are compared node pair by node pair; a pair is
dropped when the distance of the centres exceeds both covering radii plus the threshold.

Equal vectors of a label are one point with a count. Labels with many points are divided among
pivots (a bounded sample): a point belongs to its nearest pivot and also visits each lower-numbered
cell that may hold a partner (triangle inequality and bisector bounds); cells are cut into blocks
of bounded size. So a label with a third of all rows is spread over many tasks. A unit of work
returns link counts and the links that join groups, not the pairs, so its output is linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelens.llm.components import connected_components
from farelens.llm.scratch import shuffle_partitions, write_once
from farelens.llm.vectors import cosines, unit, valid_vectors, vector_key

LEAF = 24
BLOCK = 2048            # points of a cell compared as one tree
MAX_PIVOTS = 8192       # pivots sent to all tasks, over all labels
_SLACK = 1e-7


class CoverTree:
    """Nodes ``(centre, covering radius, start, end, children)`` over a permutation of the points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        if len(points):
            self._grow(0, len(points), 0, 2.0)

    def _distances(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (self.points[members] @ self.points[centre]), 0.0))

    def _grow(self, a: int, b: int, centre: int, radius: float) -> int:
        node = len(self.centre)
        members = self.order[a:b]
        dist = self._distances(centre, members)
        self.centre.append(centre)
        self.radius.append(float(dist.max()))
        self.span.append((a, b))
        self.children.append([])
        if b - a <= self.leaf or radius < 1e-6 or self.radius[node] == 0.0:
            return node
        finer = radius / 2
        while finer > self.radius[node]:
            finer /= 2                      # levels on which the node is its only child
        groups, rest, c = [], members, centre
        while len(rest):
            near = self._distances(c, rest) <= finer
            near[rest == c] = True
            groups.append((c, rest[near]))
            rest = rest[~near]
            c = int(rest[0]) if len(rest) else -1
        self.order[a:b] = np.concatenate([g for _, g in groups])
        at = a
        for c, g in groups:
            if len(groups) == 1:
                return node                 # numerically inseparable
            self.children[node].append(self._grow(at, at + len(g), c, finer))
            at += len(g)
        return node


def dual_pairs(left: CoverTree, right: CoverTree, reach: float, same: bool = False):
    """Yield (left points, right points) arrays of pairs that may lie within ``reach``.

    With ``same`` both are one tree, and each unordered pair is proposed once at most.
    """
    if not len(left.centre) or not len(right.centre):
        return
    stack = [(0, 0)]
    reach += _SLACK

    def gaps(a, b):
        """Distances of two lists of centres, less both covering radii."""
        x, y = left.points[[left.centre[i] for i in a]], right.points[[right.centre[j] for j in b]]
        d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))
        return d - np.array([left.radius[i] for i in a])[:, None] - np.array([right.radius[j] for j in b])[None, :]

    while stack:
        i, j = stack.pop()
        own = same and i == j
        a, b = left.children[i], right.children[j]
        if not a and not b:
            p = left.order[slice(*left.span[i])]
            q = right.order[slice(*right.span[j])]
            d = np.sqrt(np.maximum(2.0 - 2.0 * (left.points[p] @ right.points[q].T), 0.0))
            x, y = np.nonzero(d <= reach)
            x, y = p[x], q[y]
            if own:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        # the node with the larger radius is opened; both are when they are one node
        if own or (a and b):
            keep = gaps(a, b) <= reach
            if own:
                keep &= np.arange(len(a))[:, None] <= np.arange(len(b))[None, :]
        elif a:
            keep, b = gaps(a, [j]) <= reach, [j]
        else:
            keep, a = gaps([i], b) <= reach, [i]
        x, y = np.nonzero(keep)
        leaves = []
        for s, t in zip(x.tolist(), y.tolist()):
            if not left.children[a[s]] and not right.children[b[t]] and not (same and a[s] == b[t]):
                leaves.append((a[s], b[t]))
            else:
                stack.append((a[s], b[t]))
        single = [(s, t) for s, t in leaves if left.span[s][1] - left.span[s][0] == 1 == right.span[t][1] - right.span[t][0]]
        if single:      # two single points: the bound was their distance
            yield np.array([left.centre[s] for s, _ in single]), np.array([right.centre[t] for _, t in single])
        stack += [p for p in leaves if left.span[p[0]][1] - left.span[p[0]][0] > 1 or right.span[p[1]][1] - right.span[p[1]][0] > 1]


class _Unit:
    """Own points of a block, and the links found so far."""

    def __init__(self, reps, sizes, vectors, threshold: float):
        self.threshold, self.reach = threshold, float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0)))
        self.reps, self.sizes = np.array(reps, np.int64), np.array(sizes, np.int64)
        self.vectors = np.stack(vectors)
        self.tree = CoverTree(unit(self.vectors))
        self.counts: dict[int, int] = {}
        self.root: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []
        self._take(dual_pairs(self.tree, self.tree, self.reach, same=True), self.reps, self.sizes, self.vectors)

    def _find(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def _take(self, found, reps, sizes, vectors) -> None:
        for x, y in found:
            hit = cosines(self.vectors[x], vectors[y]) >= self.threshold
            for a, b, na, nb in zip(self.reps[x[hit]].tolist(), reps[y[hit]].tolist(), self.sizes[x[hit]].tolist(),
                                    sizes[y[hit]].tolist()):
                self.counts[a] = self.counts.get(a, 0) + nb
                self.counts[b] = self.counts.get(b, 0) + na
                ra, rb = self._find(a), self._find(b)
                if ra != rb:
                    self.root[max(ra, rb)] = min(ra, rb)
                    self.links.append((a, b))

    def meet(self, reps, sizes, vectors) -> None:
        """Compare with visiting points."""
        vectors = np.stack(vectors)
        other = CoverTree(unit(vectors))
        self._take(dual_pairs(self.tree, other, self.reach), np.array(reps, np.int64), np.array(sizes, np.int64), vectors)


_LINKS = "a long, b long, n long"
_ARROW_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compare_units(units: DataFrame, threshold: float) -> DataFrame:
    """``(a, null, n)`` link counts and ``(a, b, null)`` joining links of every unit."""

    def run(batches):
        key = current = None
        own, guests = ([], [], []), ([], [], [])

        def settle(finished: bool):
            nonlocal current, own, guests
            if current is None and own[0]:
                current, own = _Unit(*own, threshold), ([], [], [])
            if guests[0] and current is not None:
                current.meet(*guests)
            guests = ([], [], [])
            if finished and current is not None:
                done, current = current, None
                n = len(done.counts)
                yield pa.record_batch([pa.array([*done.counts, *(a for a, _ in done.links)], pa.int64()),
                                       pa.array([None] * n + [b for _, b in done.links], pa.int64()),
                                       pa.array([*done.counts.values(), *[None] * len(done.links)], pa.int64())],
                                      schema=_ARROW_LINKS)
            elif finished:
                own = ([], [], [])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for label, dims, cell, part, guest, rep, size, vector in zip(*cols):
                if (label, dims, cell, part) != key:
                    yield from settle(True)
                    key = (label, dims, cell, part)
                side = guests if guest else own
                for store, value in zip(side, (rep, size, np.frombuffer(vector))):
                    store.append(value)
                if guest and len(guests[0]) >= BLOCK:
                    yield from settle(False)
        yield from settle(True)

    n = shuffle_partitions(units.sparkSession)
    keys = ["label", "dims", "cell", "part"]
    return (units.select(*keys, "guest", "rep", "size", "vector").repartition(n, *keys)
            .sortWithinPartitions(*keys, "guest", "rep").mapInArrow(run, _LINKS))


def _spread(points: DataFrame, threshold: float) -> DataFrame:
    """Cells and blocks of the points: ``(label, dims, cell, part, guest, rep, size, vector)``."""
    spark = points.sparkSession
    held = points.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("held"))
    large = write_once(held.where(F.col("held") > BLOCK), "large-labels")
    total = large.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n")).first()["n"]
    want = min(total / BLOCK, MAX_PIVOTS)
    draw = F.pmod(F.xxhash64("rep", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    # an expected number of at most MAX_PIVOTS rows
    chosen = points.join(large.select("label", "dims"), ["label", "dims"], "left_semi").where(
        draw < (want / total if total else 0.0)).select("label", "dims", "rep", "vector").collect() if total else []
    pivots: dict[tuple, np.ndarray] = {}
    for r in sorted(chosen, key=lambda r: (r["label"], r["dims"], r["rep"])):
        pivots.setdefault((r["label"], r["dims"]), []).append(np.frombuffer(bytes(r["vector"])))
    sent = spark.sparkContext.broadcast({k: unit(np.stack(v)) for k, v in pivots.items()})
    reach = float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0)))
    names = ["label", "dims", "cell", "guest", "rep", "size", "vector"]
    schema = "label string, dims int, cell int, guest boolean, rep long, size long, vector binary"

    def assign(batches):
        for batch in batches:
            take, cell, guest = [], [], []
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                take += rows
                guest += [False] * len(rows)
                if key not in sent.value:
                    cell += [0] * len(rows)
                    continue
                centres = sent.value[key]
                v = unit(np.stack([np.frombuffer(batch.column(4)[i].as_py()) for i in rows]))
                d = np.sqrt(np.maximum(2.0 - 2.0 * (v @ centres.T), 0.0))
                home = d.argmin(axis=1)
                cell += home.tolist()
                # a partner in cell p is no farther from p than from this point's pivot
                near = d <= d.min(axis=1)[:, None] + 2 * reach + _SLACK
                near &= np.arange(len(centres))[None, :] < home[:, None]
                x, p = np.nonzero(near)
                take += [rows[i] for i in x.tolist()]
                cell += p.tolist()
                guest += [True] * len(p)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.record_batch([out.column(0), out.column(1), pa.array(cell, pa.int32()), pa.array(guest, pa.bool_()),
                                   *out.columns[2:]], names)

    placed = points.select("label", "dims", "rep", "size", "vector").mapInArrow(assign, schema)
    placed = write_once(placed, "cells")
    parts = placed.where("not guest").groupBy("label", "dims", "cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    last = F.when(F.col("guest"), F.col("parts") - 1).otherwise(F.col("own"))
    return (placed.join(parts, ["label", "dims", "cell"]).withColumn("own", own)
            .withColumn("part", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("guest", F.col("guest") | (F.col("part") != F.col("own"))))


def cover_tree_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = 0.98) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of vectors linked within their label.

    Two vectors link when their labels are equal and not null and their cosine in double precision
    is at least ``threshold``. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable over links, itself included, and ``kept`` says
    that it is the own id.

    Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
    and rows with a null label or id link with nothing; vectors of different lengths never link;
    rows equal in id, label and vector count once in ``n_links``; a row with a null id is kept
    with a null component; an empty table gives an empty result; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).alias("embedding"))
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vector", pa.binary())])

    def read(batches):
        for batch in batches:
            rows, vecs = valid_vectors(batch.column(2))
            at = dict(zip(rows.tolist(), vecs))
            keys = [vector_key(at[i]) if i in at else None for i in range(batch.num_rows)]
            raw = [(at[i] + 0.0).tobytes() if i in at else None for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                                  schema=schema)

    rows = write_once(base.mapInArrow(read, "id long, label string, key binary, vector binary"), "vectors")
    usable = rows.where("id is not null and label is not null and key is not null")
    # the vector is part of the grouped value only once per map task
    points = write_once(usable.groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.countDistinct("id").alias("size"), F.min("vector").alias("vector"))
        .withColumn("dims", F.octet_length("vector")), "points")
    found = write_once(_compare_units(_spread(points, threshold), threshold), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b is not null")).withColumnRenamed("node", "rep")
    # ids may repeat over labels, points may not: counts and groups go by representative
    told = (points.select("label", "key", "rep", "size").join(counts, "rep", "left").join(groups, "rep", "left")
            .select("label", "key", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("id", "label", "key").join(told, ["label", "key"], "left")
    usable_row = F.col("id").isNotNull() & F.col("component_id").isNotNull()
    component = F.when(usable_row, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.when(usable_row, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
