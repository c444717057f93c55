"""Hard negatives against brute force on awkward rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.llm import bond
from farelens.llm.bond import Block, Nearest, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, key string, rank int, score int, dims int"


def _rows(n=400, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims)) + 0.8
    rows = []
    for i in range(n):
        v = 0.3 * (centres[rng.integers(5)] + rng.standard_normal(dims) * rng.choice([0.05, 0.4]))
        if i % 9 == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][1])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4)) if i % 13 else None))
    hot = rows[20][1]
    rows += [(1000 + i, hot, 2) for i in range(70)]
    rows += [(2000, None, 1), (2001, [0.0] * dims, 1), (2002, [float("nan")] + [1.0] * (dims - 1), 1), (2003, [None] * dims, 1), (2020, hot, None),
             (2004, [float("-inf")] * dims, 0), (2005, [], 0), (None, hot, 1), (2010, [1.0, 2.0], 1), (2011, [1.0, 2.1], 1), (2012, [0.5, 1.0], 2),
             (1000, hot, 2), (1010, hot, 3), (40, rows[41][1], 0)]
    return [(*r, 7, "k", 1, 2, 3) for r in rows]


def _brute(rows, is_anchor, own):
    live = {}
    for r in rows:
        i, v, label = r[:3]
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(x))) for x in v]
        new = (own(i, label), len(q), np.array(q, "<i4").tobytes(), q)
        if i not in live or new[:3] < live[i][:3]:
            live[i] = new
    out = []
    for a, (label, dims, _, v) in live.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, n, _, w) in live.items() if i != a and n == dims)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block,anchors,candidates,hot", [(4096, 512, 1 << 18, 100_000), (16, 3, 100, 4)])
def test_hard_negatives(spark, monkeypatch, block, anchors, candidates, hot):
    monkeypatch.setattr(bond, "BLOCK", block)
    monkeypatch.setattr(bond, "ANCHORS", anchors)
    monkeypatch.setattr(bond, "CANDIDATES", candidates)
    rows = _rows()
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("id") % 10 == 0, label=own, hot=hot)
    want = _brute(rows, lambda i: i % 10 == 0, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_empty(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).collect() == []


def test_scan_drops_most_candidates_before_the_last_dimension():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.standard_normal((2000, 64)) * 0.98 ** np.arange(64) * 0.05).astype(np.int64)
    rows[:6] = 3 * rows[0]
    block, seen = Block(np.arange(2000), np.zeros(2000, np.int64), rows), []
    found = Nearest(0, 5)

    def prune(low, high):
        keep = found.prune(low, high)
        seen.append(int(keep.sum()))
        return keep

    alive, score = block.scan(rows[0], np.arange(2000), prune)
    found.add(score, block.ids[alive])
    exact = rows @ rows[0]
    assert found.ids.tolist() == np.lexsort((np.arange(2000), -exact))[:5].tolist()
    assert seen == sorted(seen, reverse=True) and seen[-2] < 2000 / 10


def test_large_components_stay_exact():
    rows = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 3], [5, 7]], np.int64)
    block = Block(np.arange(3), np.zeros(3, np.int64), rows)
    alive, score = block.scan(rows[1], np.arange(3), lambda low, high: np.ones(len(low), bool))
    assert score.tolist() == [sum(int(x) * int(y) for x, y in zip(r, rows[1])) for r in rows.tolist()]
