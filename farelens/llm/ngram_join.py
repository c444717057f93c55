"""Set-similarity self-join on word shingles by T-occurrence search (DivideSkip).

Two sets whose Jaccard similarity reaches ``t`` share at least ``T`` shingles, so a set's
inverted lists divide into short ones (its rarest shingles), whose merge must yield a partner at
least ``k`` times, and long ones, which are only probed by binary search for the partners that
the merge has left, stopping as soon as ``T`` is out of reach.

As Spark jobs:

1. one pass gives each document its set size and a 128-bit signature, and fills a fixed-size
   count sketch that orders shingles from rare to frequent; documents with equal sets are one
   node from here on;
2. each node posts the shingles of its short lists only; postings are sorted by shingle, which
   merges the lists. Lists of at most ``long_list`` nodes yield pairs, whose occurrences are
   counted and compared with ``k``; longer lists yield one edge per node and never pairs;
3. pairs left by the merge are checked on the whole sets;
4. nodes that meet in long lists form clusters. A cluster is cut into blocks of bounded size,
   and every pair of blocks is one unit of work, in which each set is searched by DivideSkip
   over the unit's own inverted lists; partners already joined to it are skipped;
5. links are contracted to components.

Nothing is capped: a long list changes the way its nodes are compared, not whether they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelens.llm.components import connected_components
from farelens.llm.frequency import SKETCH_SCHEMA, CountSketch, id_filter, maybe_listed, sum_sketch
from farelens.llm.scratch import bound_batches, shuffle_partitions, write_once
from farelens.llm.shingles import set_signature, shingle_sets
from farelens.llm.words import blocks

SKETCH_BITS = 21
LONG_LIST = 64           # nodes in an inverted list from which it counts as long
UNIT_SHINGLES = 400_000  # shingles in one block of a cluster


def _merge_count(n: np.ndarray) -> np.ndarray:
    """Occurrences that the short lists must yield for a set of ``n`` shingles."""
    return np.where(n >= 20, 2, 1)


def _profile(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()),
                        ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch = CountSketch(SKETCH_BITS)
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = shingle_sets(block.column("text"), words)
                sketch.add(np.concatenate(sets))
                none = pa.nulls(len(sets), pa.int32())
                yield pa.record_batch([block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([set_signature(s) if len(s) else None for s in sets], pa.binary()),
                                       none, pa.nulls(len(sets), pa.binary())], schema)
        for b, c in sketch.packed():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                   pa.array([b], pa.int32()), pa.array([c], pa.binary())], schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, " + SKETCH_SCHEMA)


def _postings(docs: DataFrame, sketch, words: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n, short)``: the shingles whose lists are short for the document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("short", pa.list_(pa.int64()))])
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches):
        counts = sketch.value
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = shingle_sets(block.column("text"), words)
                short = []
                for s in sets:
                    n = len(s)
                    take = min(n, n + (num * -n // den) + int(_merge_count(np.int64(n))))
                    order = np.lexsort((s, counts[(s >> shift).astype(np.int64)]))[:take]
                    short.append(s[order].view(np.int64))
                yield pa.record_batch([block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array(short, pa.list_(pa.int64()))], schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, short array<long>")


def _merge_lists(postings: DataFrame, num: int, den: int, long_list: int) -> DataFrame:
    """``(a, b, hits, need)`` from short lists; ``(a, b, null, null)`` edges from long ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hits", pa.int64()), ("need", pa.int64())])

    def pairs_of(token, node, n):
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(starts, len(token)))
        a, b, na, nb, edge_a, edge_b = [], [], [], [], [], []
        for c in np.unique(length[length > 1]).tolist():
            at = starts[length == c]
            if c > long_list:
                inside = (at[:, None] + np.arange(1, c)).ravel()
                edge_a.append(np.repeat(node[at], c - 1))
                edge_b.append(node[inside])
                continue
            i, j = np.triu_indices(c, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = (node[i] != node[j]) & (n[i] * den >= num * n[j])      # n ascends within a list
            i, j = i[fits], j[fits]
            a.append(node[i]), b.append(node[j]), na.append(n[i]), nb.append(n[j])
        out = []
        if a and sum(map(len, a)):
            a, b, na, nb = (np.concatenate(x) for x in (a, b, na, nb))
            need = np.minimum(_merge_count(na), _merge_count(nb))
            rows, hits = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), need], axis=1), axis=0,
                                   return_counts=True)
            out.append(pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(hits.astype(np.int64)),
                                        pa.array(rows[:, 2])], schema))
        if edge_a:
            edges = np.unique(np.stack([np.concatenate(edge_a), np.concatenate(edge_b)], axis=1), axis=0)
            out.append(pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.int64()),
                                        pa.nulls(len(edges), pa.int64())], schema))
        return out

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        long_token = hub = None          # a long list that the last batch has not ended
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy() for i in range(3)]
            if long_token is not None:
                same = int(np.searchsorted(new[0] != long_token, True)) if new[0][-1] != long_token else len(new[0])
                if same:
                    edges = np.unique(new[1][:same])
                    yield pa.record_batch([pa.array(np.full(len(edges), hub)), pa.array(edges),
                                           pa.nulls(len(edges), pa.int64()), pa.nulls(len(edges), pa.int64())], schema)
                    new = [x[same:] for x in new]
                if not len(new[0]):
                    continue
                long_token = None
            rows = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))[-1])
            if len(rows[0]) - last > long_list:
                long_token, hub = rows[0][last], rows[1][last]
                last = len(rows[0])
            if last:
                yield from pairs_of(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if len(held[0]):
            yield from pairs_of(*held)

    spark = postings.sparkSession
    tokens = postings.select(F.explode("short").alias("token"), F.col("doc_id").alias("node"), "n")
    return (tokens.repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token", "n", "node")
            .mapInArrow(run, "a long, b long, hits long, need long"))


def _reaches(common: int, na: int, nb: int, num: int, den: int) -> bool:
    return den * common >= num * (na + nb - common)


def _least_common(na, nb, num: int, den: int):
    """Smallest overlap of sets of these sizes that reaches the similarity."""
    return -(-num * (na + nb) // (num + den))


def _check_pairs(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "text_b"):
                left, right = (shingle_sets(block.column(c), words) for c in ("text_a", "text_b"))
                ok = []
                for x, y in zip(left, right):
                    # binary probe of one sorted set by the other
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    ok.append(len(x) > 0 and len(y) > 0 and
                              _reaches(int(np.count_nonzero(x[at] == y)), len(x), len(y), num, den))
                keep = pa.array(ok, pa.bool_())
                yield pa.record_batch([block.column("a").filter(keep), block.column("b").filter(keep)], schema)

    joined = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
              .select("a", "b", "text_a", "text_b"))
    return joined.mapInArrow(run, "a long, b long")


class _Groups:
    """Union-find over the sets of a unit."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)


def divide_skip(sets: list[np.ndarray], queries, index_of: np.ndarray, num: int, den: int):
    """Links of ``sets[q]`` for ``q`` in ``queries`` with the sets numbered ``index_of``.

    Yields pairs of set numbers that join two groups; a partner already in the group of the query
    is skipped, so the links give the same components as all links would.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([sets[i] for i in index_of] or [np.zeros(0, np.uint64)])
    owner = np.repeat(index_of, sizes[index_of])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    distinct, begin = np.unique(tokens, return_index=True)
    end = np.append(begin[1:], len(tokens))
    groups = _Groups(len(sets))
    for q in queries:
        s, n = sets[q], int(sizes[q])
        if not n or not len(distinct):
            continue
        at = np.searchsorted(distinct, s)
        at[at == len(distinct)] = 0
        at = at[distinct[at] == s]
        at = at[np.argsort(end[at] - begin[at], kind="stable")]       # short lists first
        least = -(-num * n // den)                                    # overlap with the smallest partner
        n_long = min(least - 1, len(at))
        short, long = at[:len(at) - n_long], at[len(at) - n_long:]
        if not len(short):
            continue
        merged, hits = np.unique(np.concatenate([owner[begin[x]:end[x]] for x in short.tolist()]), return_counts=True)
        own = groups.find(q)
        need = _least_common(n, sizes[merged], num, den)
        live = (merged != q) & (sizes[merged] * den >= num * n) & (n * den >= num * sizes[merged])
        live &= hits + n_long >= need
        live &= np.array([groups.find(int(m)) != own for m in merged], bool)
        merged, hits, need = merged[live], hits[live], need[live]
        for i, x in enumerate(long.tolist()):
            if not len(merged):
                break
            members = owner[begin[x]:end[x]]
            p = np.searchsorted(members, merged)
            p[p == len(members)] = 0
            hits = hits + (members[p] == merged)
            if i % 8 == 7 or i == n_long - 1:
                live = hits + (n_long - 1 - i) >= need
                merged, hits, need = merged[live], hits[live], need[live]
        for m in merged[hits >= need].tolist():
            ra, rb = groups.find(q), groups.find(m)
            if ra != rb:
                groups.root[max(ra, rb)] = min(ra, rb)
                yield q, m


def _search_clusters(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links inside clusters; ``members`` has ``(doc_id, cluster, n)``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    per = members.groupBy("cluster").agg((F.floor(F.sum("n") / UNIT_SHINGLES) + 1).alias("n_blocks"))
    placed = members.join(per, "cluster").withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")))).select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id")

    def search(ids, own, sets, i, j):
        ids, own = np.array(ids, np.int64), np.array(own)
        index = np.flatnonzero(own == j)
        return [(int(ids[a]), int(ids[b])) for a, b in
                divide_skip(sets, np.flatnonzero(own == i).tolist(), index, num, den) if ids[a] != ids[b]]

    def run(batches):
        unit, ids, own, sets = None, [], [], []
        for batch in batches:
            for block in blocks(batch, "text"):
                found = []
                keys = zip(*(block.column(c).to_pylist() for c in ("cluster", "i", "j", "own", "doc_id")))
                for (c, i, j, o, d), s in zip(keys, shingle_sets(block.column("text"), words)):
                    if (c, i, j) != unit:
                        if unit is not None:
                            found += search(ids, own, sets, unit[1], unit[2])
                        unit, ids, own, sets = (c, i, j), [], [], []
                    ids.append(d), own.append(o), sets.append(s)
                if found:
                    yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema)
        if unit is not None and (found := search(ids, own, sets, unit[1], unit[2])):
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema)

    n = shuffle_partitions(members.sparkSession)
    rows = units.join(texts, "doc_id").select("cluster", "i", "j", "own", "doc_id", "text")
    return (rows.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
            .mapInArrow(run, "a long, b long"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       threshold: tuple[int, int] = (8, 10), long_list: int = LONG_LIST) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of documents linked by shingle similarity.

    A document's set holds its distinct shingles of ``words`` words (A-Z lower-cased; one shorter
    than that has its whole word sequence as one shingle). Two documents link when
    ``den * |A and B| >= num * |A or B|`` for ``threshold = (num, den)``; ``component_id`` is the
    smallest id reachable over links, itself included. Shingles are compared as 64-bit, equal sets
    as 128-bit fingerprints.

    Defined cases: null, empty and word-less texts have no shingles and link with nothing
    (component is the own id); rows that share an id are one node, linked by any of their texts;
    a row with a null id gets a null component; an empty table gives an empty result; other
    columns are not read.
    """
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("threshold must be a fraction in (0, 1]")
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = write_once(_profile(base, words), "shingle-profile")
    sketch = spark.sparkContext.broadcast(sum_sketch(profile.where("block is not null"), SKETCH_BITS))
    sized = profile.where("block is null").select("doc_id", "n", "sig")
    known = sized.where("sig is not null and doc_id is not null")
    nodes = known.groupBy("sig").agg(F.min("doc_id").alias("node"))
    heads = nodes.select(F.col("node").alias("doc_id")).distinct()
    postings = _postings(base, sketch, words, num, den).where("n > 0").join(heads, "doc_id", "left_semi")
    merged = write_once(_merge_lists(postings, num, den, long_list), "merged-lists")
    pairs = write_once(merged.where("hits is not null").groupBy("a", "b").agg(
        F.sum("hits").alias("hits"), F.min("need").alias("need")).where("hits >= need").select("a", "b"), "pairs")
    clusters = connected_components(merged.where("hits is null"))
    members = write_once(known.select("doc_id", "n").join(heads, "doc_id", "left_semi").groupBy("doc_id")
                         .agg(F.sum("n").alias("n")).join(clusters.withColumnRenamed("node", "doc_id"), "doc_id")
                         .select("doc_id", F.col("component").alias("cluster"), "n"), "clusters")
    wanted = write_once(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))
                        .unionAll(members.select("doc_id")).distinct(), "candidate-ids")
    texts = write_once(maybe_listed(base, "doc_id", id_filter(wanted)).join(wanted, "doc_id", "left_semi"),
                       "candidate-texts")
    # written, so that no task searches and contracts with two Python workers at once
    links = write_once(_check_pairs(pairs, texts, words, num, den).unionAll(_search_clusters(members, texts, words, num, den)), "found-links")
    same_id = nodes.join(known, "sig").where("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(links.unionAll(same_id))
    return sized.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
