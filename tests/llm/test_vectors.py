"""Nearest neighbours and embedding dedup against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.llm import cover_tree
from farelens.llm.cover_tree import CoverTree, cover_tree_dedup
from farelens.llm.vectors import cosines, unit
from farelens.llm.vp_tree import VantagePointTree, vp_nearest

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rep int, size int, cell int"


def _rows(n=300, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(dims) * rng.choice([0.02, 0.1, 0.8])
        if i % 9 == 0 and out:
            v = np.array(out[rng.integers(len(out))][1]) * (1 if i % 2 else 2.5)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 11 else None))
    hot = out[5][1]
    out += [(1000 + i, hot, 1) for i in range(60)]
    out += [(2000, None, 1), (2001, [0.0] * dims, 1), (2002, [float("nan")] + [1.0] * (dims - 1), 1), (2003, [None] * dims, 1),
            (2004, [float("inf")] * dims, 0), (2005, [], 0), (None, hot, 1), (2006, [1.0, 2.0], 1), (2007, [1.0, 2.1], 1),
            (1001, hot, 1)]
    return [(*r, "k", 1, 2, 3) for r in out]


def _valid(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def _cos(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


@pytest.mark.parametrize("shard_size", [8192, 37])
def test_vp_nearest_is_exact_with_factor_one(spark, shard_size):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in vp_nearest(df, F.col("vec_id") % 10 == 0, k=4, shard_size=shard_size).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    live = {r[0]: r[1] for r in rows if r[0] is not None and _valid(r[1])}
    assert set(got) == {i for i in live if i % 10 == 0}
    for q, found in got.items():
        found.sort()
        want = sorted(((-_cos(live[q], v), i) for i, v in live.items() if i != q and len(v) == len(live[q])))[:4]
        assert [f[0] for f in found] == list(range(1, len(want) + 1))
        assert np.allclose([f[2] for f in found], [-w[0] for w in want], atol=1e-12)
        for (_, i, s), (_, j, t) in zip(found, found[1:]):
            assert s > t or (s == t and i < j)


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(1)
    points = unit(rng.standard_normal((10, 16))[rng.integers(10, size=3000)] + 0.3 * rng.standard_normal((3000, 16)))
    tree = VantagePointTree(points)
    exact = np.sort(points[:100] @ points.T, axis=1)[:, ::-1][:, :5]
    one, _ = tree.search(points[:100], 5, 1.0)
    assert np.allclose(one, exact, atol=1e-12)
    more, _ = tree.search(points[:100], 5, 1.5)
    assert (np.abs(more - exact) < 1e-12).mean() >= 0.9


def _five(live, q):
    """The five nearest by the library's cosine, ties to the smaller id."""
    a = np.array([live[q]] * len(live))
    scores = cosines(a, np.array(list(live.values())))
    return [i for _, i in sorted((-s, i) for i, s in zip(live, scores.tolist()) if i != q)][:5]


@pytest.mark.parametrize("shard_size", [8192, 60])
@pytest.mark.parametrize("kind", ["any", "powers"])
def test_vp_nearest_ids_of_scaled_and_near_parallel_vectors(spark, shard_size, kind):
    """40 scaled copies of one vector: by powers of two their cosines are equal and the smaller id wins."""
    rng = np.random.default_rng(8)
    live = {}
    hot = rng.standard_normal(16).astype(np.float32)
    for i in range(240):
        v = rng.standard_normal(16).astype(np.float32)
        if i % 6 == 0:
            v = hot * np.float32(2.0 ** rng.integers(-6, 7) if kind == "powers" else rng.uniform(0.2, 5))
        elif i % 29 == 0:
            v = np.nextafter(hot, np.float32(2))
        live[(i * 77) % 241] = [float(x) for x in v]
    df = spark.createDataFrame([(i, v, 0, "k", 1, 2, 3) for i, v in live.items()], SCHEMA).repartition(3)
    got = {}
    for r in vp_nearest(df, F.col("vec_id") % 5 == 0, k=5, shard_size=shard_size).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {i for i in live if i % 5 == 0}
    for q, ids in got.items():
        assert ids == _five(live, q)


def test_vp_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vp_nearest(df, F.col("vec_id") % 50 == 0).collect() == []


def test_cover_tree_levels():
    rng = np.random.default_rng(4)
    points = unit(np.repeat(rng.standard_normal((40, 6)), 5, axis=0) + 0.05 * rng.standard_normal((200, 6)))
    tree = CoverTree(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(200))
    for c, r, (a, b), kids in zip(tree.centre, tree.radius, tree.span, tree.children):
        d = np.linalg.norm(points[tree.order[a:b]] - points[c], axis=1)
        assert d.max() <= r + 1e-7
        if kids:
            assert tree.centre[kids[0]] == c                    # nested: a centre stays one
            assert sum(tree.span[k][1] - tree.span[k][0] for k in kids) == b - a


@pytest.mark.parametrize("block", [2048, 20])
def test_cover_tree_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = _rows()
    got = cover_tree_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold=0.98).collect()
    live = sorted({(r[0], tuple(r[1]), r[2]) for r in rows if r[0] is not None and r[2] is not None and _valid(r[1])})
    links, root = {}, {i: i for i, *_ in live}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, v, a in live:
        for j, w, b in live:
            if i < j and a == b and len(v) == len(w) and _cos(v, w) >= 0.98:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                ri, rj = find(i), find(j)
                root[max(ri, rj)] = min(ri, rj)
    want = sorted(((r[0], links.get(r[0], 0), root.get(r[0]) if r[0] not in root else find(r[0])) for r in rows
                   if r[0] is not None and r[0] in root), key=str)
    assert sorted(((r.id, r.n_links, r.component_id) for r in got if r.id in root), key=str) == want
    assert all(r.kept == (r.id == r.component_id) for r in got) and len(got) == len(rows)
    for r in got:
        if r.id not in root:
            assert (r.n_links, r.component_id, r.kept) == (0, r.id, True)


def test_cover_tree_empty(spark):
    assert cover_tree_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
