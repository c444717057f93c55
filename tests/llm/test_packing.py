import random
from collections import Counter, defaultdict

from pyspark.sql import Row

from farelens.llm.packing import best_fit_packing, cheapest_capacity, plan_packing

CAPS = (8, 16, 32)


def literal_best_fit(lengths, capacities=CAPS, overhead=2):
    """Piece by piece: contents of each sequence, in the order of opening."""
    counts = Counter(lengths)
    bins = []          # [room, content]
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            below = sorted(k for k in counts if k < x)
            b = [cheapest_capacity(x, capacities, counts, below, overhead), 0]
            bins.append(b)
        b[0] -= x
        b[1] += x
    return sorted(b[1] for b in bins)


def test_plan_equals_literal_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(0, 60))]
        plan = plan_packing(Counter(lengths), CAPS, 2)
        got = sorted(c for _, n, c in plan.bins for _ in range(n) if c)
        assert got == literal_best_fit(lengths)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, seq_id string")


def test_pieces_fill_sequences_without_overlap(spark):
    rng = random.Random(5)
    rows = [Row(i, " ".join(["w"] * rng.choice([0, 1, 3, 7, 8, 9, 31, 32, 33, 100])), "x", "y") for i in range(300)]
    rows += [Row(7, "a b", None, None), Row(7, "a b", None, None), Row(None, "c  d\te", None, None), Row(9000, None, None, None)]
    out = best_fit_packing(_docs(spark, rows), capacities=CAPS, overhead=2).collect()
    by_seq, words = defaultdict(list), Counter()
    for r in out:
        words[r.doc_id] += r.n_tokens
        if r.n_tokens == 0:
            assert r.seq_id is None and r.seq_tokens is None
        else:
            by_seq[r.seq_id, r.seq_tokens].append((r.seq_offset, r.n_tokens))
    want = Counter()
    for r in rows:
        want[r[0]] += len((r[1] or "").split())
    assert words == want
    assert len(by_seq) == len({s for s, _ in by_seq})
    for (_, size), spans in by_seq.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert size == min(c for c in CAPS if c >= at)
    lengths = [n for spans in by_seq.values() for _, n in spans]
    assert sorted(sum(n for _, n in s) for s in by_seq.values()) == literal_best_fit(lengths)


def test_empty_table(spark):
    assert best_fit_packing(_docs(spark, [])).collect() == []


def test_packed_sequences_hold_every_token_in_order(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from farelens.llm.packing import packed_sequences
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    theirs.no_truncation(), theirs.no_padding()
    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon-zeta 42".split()) for _ in range(rng.choice([1, 3, 9, 20, 70]))) for _ in range(40)]
    rows = [(i, t, "n", "s") for i, t in enumerate(texts)] + [(100, "", "n", "s"), (101, None, "n", "s"), (5, "again", "n", "s"), (None, "no id", "n", "s")]
    out = packed_sequences(_docs(spark, rows).repartition(5), path, capacities=CAPS, overhead=2).collect()
    found = defaultdict(list)
    for r in out:
        assert r.n_tokens == len(r.ids) <= r.seq_tokens and r.seq_tokens == min(c for c in CAPS if c >= r.n_tokens)
        at = 0
        for p in r.parts:
            assert p.offset == at
            found[p.doc_id].append((p.piece, p.start, r.ids[at:at + p.n_tokens]))
            at += p.n_tokens
        assert at == r.n_tokens
    want = Counter()
    for i, t, *_ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.update((i, k, a, tuple(ids[a:a + 32])) for k, a in enumerate(range(0, len(ids), 32)))
    assert Counter((i, k, a, tuple(x)) for i, ps in found.items() for k, a, x in ps) == want
    assert packed_sequences(_docs(spark, []), path, capacities=CAPS).collect() == []
