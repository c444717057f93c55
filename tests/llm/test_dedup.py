"""Substring, line and shingle dedup against brute force on awkward rows."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from farelens.llm.components import connected_components
from farelens.llm.line_dedup import line_dedup, line_report, winnow
from farelens.llm.ngram_join import ngram_jaccard_join
from farelens.llm.substring_dedup import substring_dedup, substring_report

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sha(b):
    return hashlib.sha256(b).hexdigest()


def _distinct(rows):
    """Judged documents in order: rows equal in id and text once; ties of the id by a hash."""
    seen = {(i, t) for i, t in rows if i is not None and t is not None}
    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    return sorted(seen, key=lambda r: (r[0], signed(r[1])))


def _covered(sequences, width):
    """Positions of each sequence covered by windows that also start earlier."""
    seen, out = set(), {}
    for key, seq in sequences:
        hit = set()
        for k in range(len(seq) - width + 1):
            w = tuple(seq[k:k + width])
            if w in seen:
                hit.update(range(k, k + width))
            seen.add(w)
        out[key] = hit
    return out


@pytest.mark.parametrize("window,seed,buckets", [(20, 4, None), (5, 2, 3), (3, 3, 1)])
def test_substring_report(odd_docs, odd_rows, window, seed, buckets):
    rows = [(r[0], r[1]) for r in odd_rows]
    hit = _covered([((i, t), WORD.findall(t.encode())) for i, t in _distinct(rows)], window)
    want = Counter()
    for i, t in rows:
        words = WORD.findall((t or "").encode())
        gone = hit.get((i, t), set())
        want[i, len(words), len(gone), _sha(b" ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    got = substring_report(odd_docs, window=window, seed=seed, buckets=buckets).collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [1, 30])
def test_windows_of_frequent_minimisers_travel_alone(odd_docs, odd_rows, monkeypatch, hot):
    """Whatever the layout, the result is the same; long words do not widen what is compared at once."""
    from farelens.llm import substring_dedup as S
    monkeypatch.setattr(S, "hot_minimisers", lambda texts, window, seed, most, f=S.hot_minimisers: f(texts, window, seed, hot))
    monkeypatch.setattr(S, "COMPARED", 64)
    rows = [(r[0], r[1]) for r in odd_rows]
    hit = _covered([((i, t), WORD.findall(t.encode())) for i, t in _distinct(rows)], 5)
    want = Counter((i, len(WORD.findall((t or "").encode())), len(hit.get((i, t), ()))) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_report(odd_docs, window=5, seed=2).collect()) == want


def test_substring_rows_repeated_over_partitions(spark):
    """A row that reaches a bucket from five tasks keeps its words; a later row still loses its copy."""
    from pyspark.sql import functions as F
    text = " ".join(f"word{k}" for k in range(60))
    rows = spark.range(5, numPartitions=5).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text"))
    later = spark.range(3, numPartitions=3).select(F.lit(9).alias("doc_id"), F.lit(f"own {text} end").alias("text"))
    docs = rows.unionAll(later)
    assert docs.rdd.getNumPartitions() == 8
    assert Counter(map(tuple, substring_dedup(docs).collect())) == Counter({(7, text): 5, (9, "own end"): 3})
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_report(docs).collect())
    assert got == Counter({(7, 60, 0): 5, (9, 62, 60): 3})


def test_substring_rewrite_keeps_rows_and_columns(odd_docs, no_docs):
    out = substring_dedup(odd_docs)
    assert out.dtypes == odd_docs.dtypes and out.count() == odd_docs.count()
    before = {(r.doc_id, r.n_chars): r.text for r in odd_docs.collect()}
    changed = 0
    for r in out.collect():
        old = before[r.doc_id, r.n_chars]
        changed += r.text != old
        assert (r.text is None) == (old is None)
        assert r.text == old or set(r.text.split(" ")) <= {*re.split(r"[ \t-\r]+", old), ""}
    assert changed > 10
    assert substring_dedup(no_docs).collect() == [] and substring_report(no_docs).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3])
def test_line_report(odd_docs, odd_rows, width):
    rows = [(r[0], r[1]) for r in odd_rows]

    def filled(t):
        return [(k, x) for k, x in enumerate(line.strip(" \t\v\f\r") for line in t.split("\n")) if x]

    hit = _covered([((i, t), [x for _, x in filled(t)]) for i, t in _distinct(rows)], width)
    want = Counter()
    for i, t in rows:
        lines = t.split("\n") if t else []
        gone = {filled(t)[k][0] for k in hit.get((i, t), ())}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want[i, len(lines), len(gone), _sha(kept.encode())] += 1
    assert Counter(map(tuple, line_report(odd_docs, min_lines=width).collect())) == want


@pytest.mark.parametrize("width,min_bytes", [(2, 20), (3, 40), (2, 1), (1, 20)])
def test_lone_long_lines(spark, odd_rows, width, min_bytes):
    long, one, short = "a long line that stands alone " * 4, "a page of one line " * 9, "short line"
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(300, f"x\n{long}\ny"), (301, f"p\n {long}\t\nq\n{long}"), (302, f"u\n{short}\nv\n{short}"),
             (303, f"w\n{short}"), (304, one), (305, one), (306, f"{one}\n\n"), (307, f"k\n{long}\n{one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def filled(t):
        return [(k, x) for k, x in enumerate(line.strip(" \t\v\f\r") for line in t.split("\n")) if x]

    judged = [((i, t), [x for _, x in filled(t)]) for i, t in _distinct(rows)]
    runs, alone, want = _covered(judged, width), _covered(judged, 1), Counter()
    size = {key: [len(x.encode()) for x in seq] for key, seq in judged}
    for i, t in rows:
        lines = t.split("\n") if t else []
        hit = runs.get((i, t), set()) | {k for k in alone.get((i, t), ()) if size[i, t][k] >= min_bytes}
        gone = {filled(t)[k][0] for k in hit}
        want[i, len(lines), len(gone), _sha("\n".join(x for k, x in enumerate(lines) if k not in gone).encode())] += 1
    got = line_report(docs, min_lines=width, min_bytes=min_bytes)
    assert Counter(map(tuple, got.collect())) == want


def test_pipeline_stage_drops_lone_long_lines(spark):
    from corpus_pipeline import drop_repeated_lines
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"x\n{long}\ny"), (2, f"p\n{long}\nq"), (3, long), (4, "p\nz"), (5, "one\nz")]
    out = drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "p\nq", 3: "", 4: "p\nz", 5: "one\nz"}


def test_line_rewrite(odd_docs, no_docs):
    out = line_dedup(odd_docs)
    assert out.dtypes == odd_docs.dtypes and out.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[109] == "start" and texts[110].strip() == "" and texts[101] is None
    assert line_dedup(no_docs).collect() == []


def test_winnow_guarantee():
    import numpy as np
    h = np.random.default_rng(1).integers(0, 50, 200, dtype=np.uint64)
    for width in (1, 2, 5):
        at = winnow(h, width)
        assert all(i <= p < i + width and h[p] == h[i:i + width].min() for i, p in enumerate(at))


def _sets(rows, k):
    out = defaultdict(set)
    for i, t in rows:
        words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        if words:
            s = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}
            out[i].add(frozenset(s))
    return out


@pytest.mark.parametrize("k,num,den,long_list", [(3, 90, 100, 64), (5, 8, 10, 3), (2, 3, 10, 2), (1, 1, 1, 64)])
def test_ngram_join(odd_docs, odd_rows, k, num, den, long_list):
    rows = [(r[0], r[1]) for r in odd_rows]
    sets = {i: s for i, s in _sets(rows, k).items() if i is not None}
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    want = Counter()
    for i, t in rows:
        own = next(iter(_sets([(i, t)], k)[i]), ())
        want[i, len(own), None if i is None else find(i)] += 1
    got = ngram_jaccard_join(odd_docs, words=k, threshold=(num, den), long_list=long_list).collect()
    assert Counter(map(tuple, got)) == want


def test_ngram_join_empty(no_docs):
    assert ngram_jaccard_join(no_docs).collect() == []


def test_components(spark):
    import random
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    edges += [(500, i) for i in range(600, 640)] + [(3, 3), (None, 4), (5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
