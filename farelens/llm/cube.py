"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target number of tokens. A document of it is taken ``floor(rate)`` times, with
``rate = target / tokens of the source``, and once more with the inclusion probability that is left.
The cube method chooses those documents: while more documents are undecided than there are
constraints, the vector of their probabilities moves along the null space of the balancing
constraints (token total and document total of the source) until one of them reaches 0 or 1. Both
totals stay as they were, so what a source yields differs from its target only by the landing: the
last dozen documents of a source, spread over all sizes, for which the choice nearest to both totals
is taken.

Scale: the flight runs in chunks of ``CHUNK`` documents of one source, cut by exact rank, so a source
that holds a third of all rows is many chunks. At most two documents a chunk stay undecided; they
meet in the next round, which is smaller by ``CHUNK / 2``, until one chunk a source is left. All random
choices come from a hash of the documents, so reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farelens.llm.ranks import groups, ranked, sorted_runs
from farelens.llm.scratch import write_once

CHUNK = 4096
LAND = 12              # documents of a source that the landing decides together, 2 ** LAND choices
WEIGHTS = (5, 2, 1)
CAP = 3
_NEAR = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def mix_targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``tree, source_size, target`` from ``tree`` and ``source_size``.

    Sources in the order of ``tree`` take the ``weights`` in turn and share the tokens of all; no target
    passes ``cap`` times its source, and the excess is shared by weight among the others until none is
    above. Each round is one aggregate over the sources and puts at least one more source at its cap.
    """
    turn = (F.col("rank") % len(weights)).cast("int")
    weighed = ranked(sources.withColumn("all", F.lit("")), "all", ["tree"]).select(
        "tree", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("w"))
    weighed = write_once(weighed, "mix-sources")
    limit = F.lit(cap) * F.col("source_size")
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("w") * F.lit(level) > limit
        r = weighed.agg(F.sum("source_size").alias("total"), F.sum(F.when(capped, limit).otherwise(F.lit(0))).alias("held"),
                        F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("w"))).alias("w"),
                        F.count_if(capped).alias("n")).first()
        if not r["total"] or not r["w"]:
            level = float("inf") if r["total"] else 0.0
            break
        new = (r["total"] - r["held"]) / r["w"]
        if level is not None and new <= level:
            break
        level = new
    target = F.when(F.col("w") * F.lit(level) > limit, limit.cast("double")).otherwise(F.col("w") * F.lit(level))
    return weighed.select("tree", "source_size", target.alias("target"))


def flight(sizes: list[int], chances: list[float], seed: int) -> list[float]:
    """Chances after the flight: all but two at most are 0 or 1; both totals are kept.

    The documents come in order; three undecided ones at a time move along the null vector of
    their 2 x 3 constraint matrix (of two with equal sizes: one up, one down).
    """
    rng = np.random.Generator(np.random.PCG64(seed)).random
    out = list(chances)
    held: list[int] = []

    def move(who, u):
        up = min(((1 - out[i]) if v > 0 else out[i]) / abs(v) for i, v in zip(who, u) if v)
        down = min((out[i] if v > 0 else (1 - out[i])) / abs(v) for i, v in zip(who, u) if v)
        step = up if rng() * (up + down) < down else -down
        for i, v in zip(who, u):
            x = out[i] + step * v
            out[i] = 0.0 if x < _NEAR else 1.0 if x > 1 - _NEAR else x

    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        held.append(i)
        while len(held) >= 2:
            a, b = held[-2:]
            if sizes[a] == sizes[b]:
                move((a, b), (1.0, -1.0))
            elif len(held) == 3:
                a, b, c = held
                if sizes[a] == sizes[b]:
                    move((a, b), (1.0, -1.0))
                elif sizes[a] == sizes[c]:
                    move((a, c), (1.0, -1.0))
                else:
                    widest = float(max(abs(sizes[c] - sizes[b]), abs(sizes[a] - sizes[c]), abs(sizes[b] - sizes[a])))
                    move((a, b, c), ((sizes[c] - sizes[b]) / widest, (sizes[a] - sizes[c]) / widest, (sizes[b] - sizes[a]) / widest))
            else:
                break
            held = [j for j in held if 0 < out[j] < 1]
    return out


def landing(sizes: list[int], chances: list[float]) -> list[float]:
    """Decide the ``LAND`` undecided documents at most: the choice nearest to both totals, tokens first.

    All choices are tried; of equally near ones the first in the order of documents holds.
    """
    out = list(chances)
    open_ = [i for i, p in enumerate(out) if 0 < p < 1]
    if not open_:
        return out
    taken = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(np.float64)
    size, chance = np.array([sizes[i] for i in open_], np.float64), np.array([out[i] for i in open_])
    off_tokens = np.round(np.abs(taken @ size - chance @ size), 6)
    off_documents = np.round(np.abs(taken.sum(axis=1) - chance.sum()), 6)
    best = np.lexsort((off_documents, off_tokens))[0]
    for i, x in zip(open_, taken[best].tolist()):
        out[i] = x
    return out


def decide(sizes: list[int], chances: list[float], seed: int) -> list[float]:
    """Flight and landing of the last chunk: documents spread over all sizes are spared for the landing."""
    order = [i for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)) if 0 < chances[i] < 1]
    spared = {order[(2 * j + 1) * len(order) // (2 * LAND)] for j in range(LAND - 2)} if len(order) > LAND else set(order)
    flown = [i for i in order if i not in spared]
    out = list(chances)
    for i, x in zip(flown, flight([sizes[i] for i in flown], [chances[i] for i in flown], seed)):
        out[i] = x
    return landing(sizes, out)


def _seed(tree: str, chunk: int, level: int, ids: list) -> int:
    said = f"{tree}|{chunk}|{level}|{ids[0]}|{ids[-1]}|{len(ids)}"
    return int.from_bytes(hashlib.blake2b(said.encode(), digest_size=8).digest(), "little")


def _fly(chances: DataFrame, chunk: int) -> DataFrame:
    """``tree, rank, chance`` (0 or 1) of the undecided rows ``tree, rank, open_size, id, size, chance``."""
    schema = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("open_size", pa.int64()), ("id", pa.int64()),
                        ("size", pa.int64()), ("chance", pa.float64())])

    def step(level: int):
        def run(batches):
            for t in groups(batches, 2):
                sizes, p = t["size"].to_pylist(), t["chance"].to_pylist()
                tree, block = t["tree"][0].as_py(), t["block"][0].as_py()
                seed = _seed(tree, block, level, t["id"].to_pylist())
                last = t["open_size"][0].as_py() <= chunk ** level
                p = (decide if last else flight)(sizes, p, seed)
                yield pa.record_batch([*(t.select(schema.names[:5]).combine_chunks().to_batches()[0].columns),
                                       pa.array(p, pa.float64())], schema=schema)
        return run

    largest = chances.agg(F.max("open_size")).first()[0] or 0
    rows, decided, level, width = chances, None, 1, chunk
    while True:
        block = F.expr(f"rank div {width}")
        runs = sorted_runs(rows.select("tree", block.alias("block"), *schema.names[1:]), ["tree", "block"], ["rank"])
        moved = write_once(runs.mapInArrow(step(level), "tree string, rank long, open_size long, id long, size long, chance double"),
                           "mix-flight")
        settled = moved.where("chance in (0, 1)").select("tree", "rank", "chance")
        decided = settled if decided is None else decided.unionByName(settled)
        if width >= largest:
            return decided
        rows, level, width = moved.where("chance not in (0, 1)"), level + 1, width * chunk


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights=WEIGHTS, cap: int = CAP, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, source, size, source_size, target, copies`` (and the columns of ``carry``), one row per document.

    ``copies`` tells how often the mix takes the document, ``cap`` times at most; ``take_copies`` repeats the
    rows so. Sources are ordered by the bytes of their name (which is the order of code points), null last.

    Defined cases: a null, empty or word-less text has size 0 and adds nothing to its source; a null
    source is a source of its own; null ids come first in their source; rows that repeat an id are
    documents of their own (equal in size, they are interchangeable); a table without words has
    targets of 0 and no copies; an empty table gives an empty result; other columns are not read.
    """
    # 's' before the name keeps the bytewise order; 't' comes after all of them
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("t"))
    kept = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry]
    slim = write_once(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), tree.alias("tree"),
                                  F.col(f"`{source_col}`").alias("source"), word_count(text_col).alias("size"), *kept), "mix-sizes")
    targets = mix_targets(slim.groupBy("tree").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = write_once(ranked(slim, "tree", ["id", "size"], targets).withColumn("rate", rate)
                        .withColumn("whole", F.floor("rate")), "mix-documents")
    undecided = placed.where("rate > whole").select(
        "tree", "rank", F.col("group_size").alias("open_size"), "id", "size", (F.col("rate") - F.col("whole")).alias("chance"))
    out = placed.join(_fly(undecided, chunk), ["tree", "rank"], "left")
    copies = (F.col("whole") + F.coalesce(F.col("chance"), F.lit(0.0))).cast("int")
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"),
                      *[F.col(f"carried_{c}").alias(c) for c in carry])


def take_copies(mix: DataFrame) -> DataFrame:
    """The rows of the mix: each row as often as its ``copies`` say, numbered by ``copy`` from 1."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
