"""Registered queries of the corpus operators: ``(spark, sf_dir) -> DataFrame``, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows of ``documents`` removed; one row per document."""
    from farelens.llm.substring_dedup import substring_report
    return substring_report(_table(spark, sf_dir, "documents"), window=20)


@_query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under 3-word shingle similarity of 0.9 or more."""
    from farelens.llm.ngram_join import ngram_jaccard_join
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), words=3, threshold=(90, 100))


@_query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents`` under the public 49k word vocabulary, and their decoding."""
    import public_tokenizers
    from farelens.llm.bpe import bpe_round_trip
    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), rewrite=False)


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learnt from ``labels`` outside the held-out quarter."""
    from farelens.llm.toxicity import fit_toxicity, score_toxicity
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
                         F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learnt outside the held-out quarter."""
    from farelens.llm.language_id import fit_language, identify_language
    docs = _table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), fit_language(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
                        "lang_pred", F.col("lang_score").alias("score"))


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of two or more lines, or of one line of 20 bytes or more, removed from ``documents``; one row per document."""
    from farelens.llm.line_dedup import line_report
    return line_report(_table(spark, sf_dir, "documents"), min_lines=2, min_bytes=20)


_TRIM = "chr(32)||chr(9)||chr(11)||chr(12)||chr(13)"
SQL["op8_line_dedup"] = f"""
WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN NULL ELSE text END AS text FROM documents),
l AS (SELECT doc_id, u.line AS line, u.pos AS pos
      FROM d, unnest(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1))) AS t(u0),
      LATERAL (SELECT u0[1] AS line, u0[2] AS pos) AS u),
f AS (SELECT doc_id, pos, trim(line, {_TRIM}) AS line,
             row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
      FROM l WHERE trim(line, {_TRIM}) <> ''),
r AS (SELECT a.doc_id, a.k, a.line AS x, b.line AS y
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
s AS (SELECT doc_id, k, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, k) AS seen FROM r),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS seen FROM f WHERE strlen(line) >= 20),
g AS (SELECT f.doc_id, f.pos FROM s JOIN f ON s.doc_id = f.doc_id AND f.k IN (s.k, s.k + 1) WHERE s.seen > 1
      UNION SELECT doc_id, pos FROM o WHERE seen > 1),
p AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
             coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n_removed, 0) AS n_removed,
       sha256(coalesce(p.kept, '')) AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id
"""


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ``documents`` placed in sequences of 512 to 4096 words."""
    from farelens.llm.packing import best_fit_packing
    return best_fit_packing(_table(spark, sf_dir, "documents"))


@_query
def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, indexed, and read back through the index."""
    from farelens.llm.warc import warc_round_trip
    return warc_round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


SQL["op1_warc_round_trip"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND head < page_id THEN head END AS refers_to
FROM f
"""


@_query
def op2_vp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth row of ``embeddings``."""
    from farelens.llm.vp_tree import vp_nearest
    return vp_nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query
def op3_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links (cosine of 0.98 or more within a label) over ``embeddings``."""
    from farelens.llm.cover_tree import cover_tree_dedup
    return cover_tree_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.98).withColumnRenamed("id", "vec_id")


SQL["op3_cover_tree_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, e, list_dot_product(e, e) AS sq
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM v WHERE sq > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(a.sq) * sqrt(b.sq)) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.id LEFT JOIN n ON e.vec_id = n.a
"""


_WORDS = r"'[^\x20\x09-\x0D]+'"
SQL["op6_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM w WHERE len(ws) >= 20),
x AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(ws[k:k + 19], ' ') ORDER BY doc_id, k) AS seen FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS pos FROM x WHERE seen > 1),
f AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
p AS (SELECT f.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
             string_agg(CASE WHEN g.pos IS NULL THEN f.word END, ' ' ORDER BY f.pos) AS kept
      FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.pos = g.pos GROUP BY f.doc_id)
SELECT w.doc_id, coalesce(p.n_words, 0) AS n_words, coalesce(p.n_removed, 0) AS n_removed,
       sha256(coalesce(p.kept, '')) AS kept_sha256
FROM w LEFT JOIN p ON w.doc_id = p.doc_id
"""

SQL["op10_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 2], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS k FROM w WHERE len(ws) >= 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM r LEFT JOIN n ON r.id = n.doc_id GROUP BY r.id
"""


@_query
def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings`` for its five best positives."""
    from farelens.llm.bond import hard_negatives
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=own)


SQL["op11_bond_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score,
                            row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS n FROM s WHERE same) WHERE n <= 5),
w AS (SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every row of ``documents``; half of them present a tampered text."""
    from farelens.llm.merkle import merkle_report
    return merkle_report(_table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang", "n_chars", "text"],
                         tampered={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))},
                         where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0).withColumnRenamed("id", "doc_id")


# crc32 of the decimal id: bytes folded one by one with eight shifts each; its lowest bit is flipped at the end
_CRC_EVEN = ("(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
             "lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda r, i: "
             "CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) % 2 = 1)")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(levels: str, leaves: str) -> str:
    """Every level of the trees over ``leaves`` (t, k, h), three nodes to a parent; n is the size of the level."""
    return f"""
{levels}(t, l, k, h, n) AS (
  SELECT t, 0, k, h, count(*) OVER (PARTITION BY t) FROM {leaves}
  UNION ALL
  SELECT t, max(l) + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), count(*) OVER (PARTITION BY t)
  FROM {levels} WHERE n > 1 GROUP BY t, k // 3)"""


SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS t, {_leaf_sql('text')} AS leaf,
         {_leaf_sql("replace(text, chr(10), '')")} AS changed, coalesce({_CRC_EVEN}, FALSE) AS tampered FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
a0 AS (SELECT t, k, leaf AS h FROM i),{_tree_sql("a", "a0")},
sub AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS k FROM a WHERE n = 1),
b0 AS (SELECT '' AS t, k, h FROM sub),{_tree_sql("b", "b0")},
nodes AS (SELECT t, l, k, h FROM a UNION ALL SELECT 'top', l, k, h FROM b),
runs AS (SELECT t, l, k // 3 AS p, list(struct_pack(k := k, h := h) ORDER BY k) AS ks FROM nodes GROUP BY t, l, k // 3),
tops AS (SELECT t, max(l) AS top FROM nodes GROUP BY t),
c(kk, t, own, l, k, h, proof) AS (
  SELECT i.t || '|' || i.k, i.t, i.t, 0, i.k, CASE WHEN tampered THEN changed ELSE leaf END, '' FROM i
  UNION ALL
  SELECT * FROM (
    SELECT c.kk, c.t, c.own, c.l + 1, c.k // 3,
           sha256(array_to_string(list_transform(r.ks, lambda x: CASE WHEN x.k = c.k THEN c.h ELSE x.h END), '')),
           c.proof || array_to_string(list_transform(list_filter(r.ks, lambda x: x.k <> c.k), lambda x: x.h), '')
    FROM c JOIN tops ON c.t = tops.t AND c.l < tops.top JOIN runs r ON r.t = c.t AND r.l = c.l AND r.p = c.k // 3
    UNION ALL
    SELECT c.kk, 'top', c.own, 0, sub.k, c.h, c.proof
    FROM c JOIN tops ON c.t = tops.t AND c.l = tops.top AND c.t <> 'top' JOIN sub ON sub.t = c.t)),
f AS (SELECT c.kk, c.h, c.proof FROM c JOIN tops ON c.t = 'top' AND tops.t = 'top' AND c.l = tops.top),
r AS (SELECT h AS root FROM b WHERE n = 1)
SELECT i.doc_id, i.leaf, sub.h AS subroot, r.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM i JOIN f ON f.kk = i.t || '|' || i.k JOIN sub ON sub.t = i.t, r
"""


@_query
def op13_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to source weights 5, 2, 1 by balanced sampling; what each document gives."""
    from farelens.llm.cube import mix_sources
    mix = mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
