"""Stages and run of the corpus pipeline on awkward rows."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from farelens.llm.ngram_join import ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    """``documents`` with null, empty, long and repeated rows and clashing names, and ``labels`` for some of them."""
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = odd_docs.withColumns({"toxic_score": F.lit("mine"), "TOXIC_predicted": F.lit(5), "seq_id": F.lit("s"), "component_id": F.lit(1.5)})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_jaccard_join", "substring_dedup"])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, folder, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, docs, folder)
    assert out.dtypes == docs.dtypes
    got, before = out.collect(), Counter(r.doc_id for r in docs.collect())
    assert not Counter(r.doc_id for r in got) - before
    # the toxicity stage scores a null text like any text without evidence, and never reads the id
    assert name == "toxicity" or any(r.text is None for r in got) and any(r.doc_id is None for r in got)
    assert {r.toxic_score for r in got} == {"mine"} and {r.component_id for r in got} == {1.5}
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_toxic_stage_drops_what_the_model_rejects(spark, docs, folder):
    from farelens.llm.toxicity import fit_toxicity, score_toxicity
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels), score_col="s", predicted_col="p").collect()
    want = Counter((r.doc_id, r.text) for r in scored if not r.p)
    assert Counter((r.doc_id, r.text) for r in P.drop_toxic(spark, docs, folder).collect()) == want


def test_near_copy_stage_keeps_the_smallest_of_each_group(spark, docs, folder):
    groups = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs, words=5, threshold=(8, 10)).collect()}
    rows = docs.select("doc_id", "text").collect()
    out = Counter((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, folder).collect())
    # rows repeated under the one kept id all stay, and so do rows without an id
    assert out == Counter((r.doc_id, r.text) for r in rows if r.doc_id is None or groups[r.doc_id] == r.doc_id)
    assert sum(out.values()) < len(rows)


def test_packing_stage_holds_every_word(spark, docs, folder):
    out = P.pack_sequences(spark, docs, folder).collect()
    words = Counter()
    for r in docs.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    held = Counter()
    for r in out:
        held[r.doc_id] += r.n_tokens
        assert (r.seq_id is None) == (r.n_tokens == 0) and (r.seq_tokens in (512, 1024, 2048, 4096, None))
    assert held == words
    used = Counter()
    for r in out:
        if r.n_tokens:
            used[r.seq_id, r.seq_tokens] += r.n_tokens
    assert all(n <= size for (_, size), n in used.items())
    assert P.pack_sequences(spark, docs.limit(0), folder).collect() == []


def test_run_applies_the_stages_one_after_another(spark, folder):
    got = Counter(map(tuple, P.run(spark, folder).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema) if stage is not P.pack_sequences \
            else stage(spark, docs, folder)
    # sequences are numbered alike for equal inputs; pieces of equal id and length are interchangeable
    want = Counter(map(tuple, docs.collect()))
    assert Counter((t[0], t[3]) for t in got.elements()) == Counter((t[0], t[3]) for t in want.elements())
    assert Counter(t[5] for t in got.elements()) == Counter(t[5] for t in want.elements())
