"""Toxicity and language models: held-out accuracy, gradients and awkward rows."""
import zlib

import numpy as np
import pyarrow as pa
import pytest

from farelens.llm.language_id import LanguageModel, fit_language, identify_language, windows
from farelens.llm.queries import QUERIES
from farelens.llm.toxicity import ORDER, WINDOW, ToxicityModel, fit_toxicity, grams, kneser_ney_ratios, score_toxicity

SF = "/root/testdata/sf0.1"


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect()
    tp = fp = fn = 0
    for i, toxic in labels:
        r = got[i]
        assert r.held_out == _held_out(i) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        if r.held_out:
            tp += toxic and r.predicted
            fp += r.predicted and not toxic
            fn += toxic and not r.predicted
    assert tp / (tp + fn) > 0.6 and tp / (tp + fp) > 0.6       # about 300 toxic documents to learn from


def test_toxicity_does_not_read_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic").collect()
    flipped = [(i, 1 - t if _held_out(i) else t) for i, t in labels]
    a = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = fit_toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert (a.table == b.table).all() and (a.more_keys == b.more_keys).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_kneser_ney_ratio_signs():
    texts = pa.array(["you idiot you idiot fool", "a calm and kind word here"])
    g = grams(texts)
    keys, at = np.unique(g.keys[g.inside()], return_inverse=True)
    toxic = np.bincount(at[:g.counts[0]], minlength=len(keys)).astype(float)
    calm = np.bincount(at[g.counts[0]:], minlength=len(keys)).astype(float)
    ratio = kneser_ney_ratios(keys, calm, toxic)
    assert (ratio[toxic > calm] > 0).mean() > 0.8 and (ratio[toxic < calm] < 0).mean() > 0.8
    decoded = [int(k).to_bytes(8, "little")[:ORDER] for k in keys]
    assert b" idio" in decoded


def _plain_models(toxic: list[bytes], calm: list[bytes]):
    """Modified Kneser-Ney by dictionaries: p(last byte | the bytes before) per class over a shared backoff."""
    from collections import Counter, defaultdict
    counts = {1: Counter(toxic), 0: Counter(calm)}
    both = set(toxic) | set(calm)

    def discounts(table):
        n = [max(sum(v == k for v in table.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k), 0.95 * k) for k in (1, 2, 3)]
        return lambda c: 0.0 if c == 0 else d[min(c, 3) - 1]

    levels = {ORDER: both}
    seen = {}
    for order in range(ORDER - 1, 0, -1):
        seen[order] = Counter(g[1:] for g in levels[order + 1])
        levels[order] = set(seen[order])

    def backoff(g):
        table = seen[len(g)]
        if len(g) == 1:
            return (table[g] + 0.5) / (sum(table.values()) + 128.0)
        same = {h: c for h, c in table.items() if h[:-1] == g[:-1]}
        cut, total = discounts(table), sum(same.values())
        return (table[g] - cut(table[g])) / total + sum(map(cut, same.values())) / total * backoff(g[1:])

    def probability(kind, g):
        # zero counts of the other class take part, as they do in the table of all n-grams
        table = {h: counts[kind][h] for h in both}
        same = {h: c for h, c in table.items() if h[:-1] == g[:-1]}
        cut, total = discounts(table), sum(same.values())
        weight = sum(map(cut, same.values())) / total if total else 1.0
        return (table[g] - cut(table[g])) / max(total, 1.0) + weight * backoff(g[1:])

    return {g: float(np.log(probability(1, g)) - np.log(probability(0, g))) for g in both}


def test_kneser_ney_against_dictionaries():
    """Every ratio, and every window score, equals a literal model over dictionaries; no n-gram is lost."""
    toxic = ["you idiot you idiot fool you", "fool of a fool"]
    calm = ["a calm and kind word here", "you are kind", "a word of calm", "kin"]

    def padded(t):
        return b" " + t.encode() + b" "

    def plain(t):
        return [padded(t)[i:i + ORDER] for i in range(len(padded(t)) - ORDER + 1)]

    want = _plain_models([g for t in toxic for g in plain(t)], [g for t in calm for g in plain(t)])
    g = grams(pa.array(toxic + calm))
    keys, at = np.unique(g.keys[g.inside()], return_inverse=True)
    of = np.repeat(np.arange(len(toxic + calm)), g.counts)
    n1 = np.bincount(at[of < len(toxic)], minlength=len(keys)).astype(float)
    n0 = np.bincount(at[of >= len(toxic)], minlength=len(keys)).astype(float)
    got = dict(zip((int(k).to_bytes(8, "little")[:ORDER] for k in keys), kneser_ney_ratios(keys, n0, n1)))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    model = ToxicityModel(keys, np.array([want[int(k).to_bytes(8, "little")[:ORDER]] for k in keys]))
    for t in [*toxic, *calm, "", "a", "fool", "you idiot and a calm word for all the kind fools here", "zzz"]:
        r = [want.get(x, 0.0) for x in plain(t)] if t else []
        w = min(WINDOW, len(r))
        worst = max((sum(r[i:i + w]) / w for i in range(len(r) - w + 1)), default=0.0) if w else 0.0
        assert abs(model.worst_windows(pa.array([t]))[0] - worst) < 1e-3, t


def test_no_n_gram_is_lost():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 200_000, dtype=np.uint64))
    ratios = rng.uniform(-10, 10, len(keys))
    model = ToxicityModel(keys, ratios)
    assert np.array_equal(model.ratios(keys), np.rint(ratios * 2000).astype(np.int16)) and len(model.more_keys) > 1000
    others = np.setdiff1d(rng.integers(0, 1 << 40, 200_000, dtype=np.uint64), keys)
    assert not model.ratios(others).any()


def test_toxicity_awkward_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    model = fit_toxicity(odd_docs, labels)
    out = score_toxicity(odd_docs.withColumnRenamed("fp", "toxic_score"), model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    assert score_toxicity(no_docs, model).collect() == []
    for table in (labels.where("toxic = 1"), labels.limit(0)):
        assert all(0 <= r.toxic_score <= 1 for r in score_toxicity(odd_docs, fit_toxicity(odd_docs, table)).collect())
    assert fit_toxicity(no_docs, labels.limit(0)).slope == 0


def test_language_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [(got[i], lang) for i, lang in docs if _held_out(i) and lang]
    assert all(r.held_out and 0 <= r.score <= 1 for r, _ in held)
    assert np.mean([r.lang_pred == lang for r, lang in held]) > 0.97


def test_training_windows_are_a_parameter(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 30, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in (1, None):
        found = identify_language(docs, fit_language(docs, rounds=60, doc_windows=n)).collect()
        assert np.mean([r.lang == r.lang_pred for r in found]) > 0.9
    with pytest.raises(ValueError):
        fit_language(docs, doc_windows=0)


def test_gradient_through_time():
    model = LanguageModel(["a", "b", "c"], hidden=3, seed=1)
    for d in (model.ahead, model.back):
        d.byte, d.gates, d.state = (p.astype(np.float64) for p in d.params())
    x = np.random.default_rng(2).integers(97, 123, (7, 5))
    target = np.random.default_rng(3).standard_normal((7, 3, 5))
    d = model.ahead
    grads = d.backward(d.forward(x), target)
    for p, g in zip(d.params(), grads):
        for at in [(0, 0), (p.shape[0] - 1, p.shape[1] - 1), (1, 100 % p.shape[1])]:
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up = (np.stack(d.forward(x)["h"]) * target).sum()
            p[at] = old - eps
            down = (np.stack(d.forward(x)["h"]) * target).sum()
            p[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=1e-3, abs=1e-4)


def test_scoring_sums_equal_stepwise_states():
    model = LanguageModel(["a", "b"], seed=4)
    texts = pa.array(["abc", "", None, "x" * 200, "hello wörld " * 30])
    x, size, doc = windows(texts)
    mean = np.zeros((len(texts), 2 * len(model.ahead.state)))
    f, b = model.ahead.forward(x.T.astype(int)), model.back.forward(x.T[::-1].astype(int))
    states = np.concatenate([np.stack(f["h"]), np.stack(b["h"])[::-1]], axis=1)
    for w in range(len(x)):
        mean[doc[w]] += states[:size[w], :, w].sum(axis=0)
    mean /= np.maximum(np.bincount(doc, size, len(texts)), 1)[:, None]
    logits = mean @ model.out.T + model.bias.T
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    got = model.probabilities(texts)
    assert np.allclose(got[[0, 3, 4]], want[[0, 3, 4]], atol=1e-4) and np.allclose(got[[1, 2]], 0.5)


def test_language_awkward_rows(odd_docs, no_docs):
    model = fit_language(odd_docs, rounds=3)
    rows = identify_language(odd_docs.withColumnRenamed("fp", "lang_score"), model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
        else:
            assert r.lang_pred == "en" and 0 < r.lang_score <= 1
    assert fit_language(no_docs) is None
    assert identify_language(no_docs, None).collect() == []
    assert {r.lang_pred for r in identify_language(odd_docs, None).collect()} == {"und"}
