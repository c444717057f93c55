"""Toxicity scores from class-conditional Kneser-Ney models over character n-grams.

Two interpolated modified Kneser-Ney models of order ``ORDER`` over lower-cased UTF-8 bytes, one for toxic
and one for ordinary documents, share their backoff distribution: the lower orders are built from
the continuation counts of both classes together. A rare expression is thus judged by its class
only as far as its class counts, less the discount, carry it; an n-gram that neither class has
seen backs off to the same shared probability in both and says nothing.

The log-likelihood ratio is normalised by length over every window of ``WINDOW`` n-grams, and a
document is as toxic as its worst window; a logistic curve turns that into a probability. It is
fitted on a quarter of the sample with counts of the other three; the final counts use all of it.

Fitting reads a bounded sample: at most ``MAX_DOCS`` labelled documents of each class (an expected
number, chosen by a hash of the id), counted as Spark jobs; the table of all their n-grams is the
model. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from farelens.llm.scratch import bound_batches
from farelens.llm.words import blocks, find_words

ORDER = 5
WINDOW = 16
MAX_DOCS = 8_000
_SCALE = 2_000.0       # ratios are kept as 16-bit multiples of 1 / _SCALE
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(1 << 63)      # flag of a slot that more than one n-gram falls into; a key has 8 * ORDER bits


def _masked(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


@dataclass
class Grams:
    """Byte n-grams of a block: keys at every position, and the span of each document."""

    keys: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    def inside(self) -> np.ndarray:
        """Positions whose n-gram lies in one document."""
        first = np.repeat(self.starts - (np.cumsum(self.counts) - self.counts), self.counts)
        return first + np.arange(len(first))


def grams(texts: pa.Array) -> Grams:
    """n-grams of the lower-cased words of each text, joined and enclosed by single spaces."""
    words = find_words(texts, lower=True)
    n = len(words.data)
    padded = np.empty(n + 9, np.uint8)
    padded[0] = 0x20
    padded[1:n + 1] = words.data
    padded[n + 1:] = 0
    keys = np.array(np.ndarray((n + 1,), "<u8", padded, strides=(1,))) & _masked(ORDER)
    edge = np.append(words.starts, n)[words.first]
    sizes = np.diff(edge)
    return Grams(keys, edge[:-1], np.where(sizes > 0, np.maximum(sizes + 2 - ORDER, 0), 0))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of each count: estimated for counts of one, two, and three or more."""
    n = [max(int((counts == k).sum()), 1) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    d = [min(max(x, 0.1 * k), 0.95 * k) for k, x in zip((1, 2, 3), d)]
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def _sums(keys: np.ndarray, *weights: np.ndarray):
    """Distinct keys, position of each input key among them, and the sum of each weight."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at, [np.bincount(at, w, len(distinct)) for w in weights]


def _shared_backoff(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Continuation probability of each ``order``-gram ending one of the distinct longer ``keys``.

    The first byte of an n-gram is in the lowest bits, so a shift by eight drops it.
    """
    grams_, _, (seen,) = _sums(keys >> np.uint64(8), np.ones(len(keys)))
    if order == 1:
        return grams_, (seen + 0.5) / (seen.sum() + 128.0)
    taken = _discounts(seen)
    _, at, (total, freed) = _sums(grams_ & _masked(order - 1), seen, taken)
    shorter, p = _shared_backoff(grams_, order - 1)
    lower = p[np.searchsorted(shorter, grams_ >> np.uint64(8))]
    return grams_, (seen - taken) / total[at] + (freed / total)[at] * lower


def kneser_ney_ratios(keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log ratio of the toxic and the ordinary probability of each distinct n-gram's last byte."""
    shorter, p = _shared_backoff(keys, ORDER - 1)
    lower = p[np.searchsorted(shorter, keys >> np.uint64(8))]
    logs = []
    for counts in (toxic, ordinary):
        taken = _discounts(counts)
        _, at, (total, freed) = _sums(keys & _masked(ORDER - 1), counts, taken)
        backoff = np.where(total > 0, freed / np.maximum(total, 1.0), 1.0)
        logs.append(np.log((counts - taken) / np.maximum(total, 1.0)[at] + backoff[at] * lower))
    return logs[0] - logs[1]


class ToxicityModel:
    """Ratio table of all n-grams and the calibration curve.

    The table has about two slots per n-gram and keeps the whole key, so no n-gram is taken for another; those
    that find their slot taken are kept sorted beside it and searched for where the slot says so.
    """

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.bits = max(10, int(2 * len(keys)).bit_length())
        value = np.clip(np.rint(ratios * _SCALE), -32767, 32767).astype(np.int16).view(np.uint16).astype(np.uint64)
        slot = self._place(keys)
        order = np.lexsort((keys, slot))
        keys, value, slot = keys[order], value[order], slot[order]
        again = np.zeros(len(keys), bool)
        again[1:] = slot[1:] == slot[:-1]
        self.table = np.zeros(1 << self.bits, np.uint64)
        self.table[slot[~again]] = keys[~again] << np.uint64(16) | value[~again]
        self.table[slot[again]] |= _MORE
        more = np.argsort(keys[again])
        self.more_keys, self.more_values = keys[again][more], value[again][more].astype(np.uint16).view(np.int16)
        self.slope, self.offset = slope, offset

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULT >> np.uint64(64 - self.bits)).astype(np.int64)

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Ratio of each n-gram in multiples of ``1 / _SCALE``; 0 where neither class has seen it."""
        found = self.table[self._place(keys)]
        own = (found & ~_MORE) >> np.uint64(16) == keys
        out = np.where(own, found.astype(np.uint16).view(np.int16), 0)
        left = np.flatnonzero(~own & (found >= _MORE))
        if len(left):
            at = np.minimum(np.searchsorted(self.more_keys, keys[left]), len(self.more_keys) - 1)
            out[left] = np.where(self.more_keys[at] == keys[left], self.more_values[at], 0)
        return out

    def worst_windows(self, texts: pa.Array) -> np.ndarray:
        """Largest mean ratio over the windows of each text (0 for a text without n-grams).

        A text of fewer n-grams than a window is one window of its own length.
        """
        g = grams(texts)
        ratio = self.ratios(g.keys)
        sums = np.zeros(len(ratio) + 1, np.int64)
        np.cumsum(ratio, out=sums[1:])
        short = g.counts < WINDOW
        out = (sums[g.starts + g.counts] - sums[g.starts]).astype(np.float64)
        long = np.flatnonzero(~short)
        if len(long):
            window = np.append(sums[WINDOW:] - sums[:-WINDOW], 0)
            cuts = np.stack([g.starts[long], g.starts[long] + g.counts[long] - WINDOW + 1], axis=1).ravel()
            out[long] = np.maximum.reduceat(window, cuts)[::2]
        return out / (np.clip(g.counts, 1, WINDOW) * _SCALE)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * self.worst_windows(texts) + self.offset)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic regression with a small ridge, by Newton steps."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-2 * beta
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_docs: int = MAX_DOCS) -> ToxicityModel:
    """Fit on labelled documents whose ``crc32(id as text) mod 4`` is not 2.

    ``labels`` has the id and a 0/1 label; a document labelled more than once is toxic if any of
    its labels is; null ids and labels are ignored. A quarter of the sample calibrates the score.
    Without documents of both classes every score is the share of toxic labels (0.0 without labels).
    """
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
              .where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = min(max(float(n.get(1, 0) > 0), 1e-9), 1 - 1e-9)
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(np.log(share / (1 - share))))
    part = {c: min(1.0, max_docs / n[c]) for c in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = marked.where(draw < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0])).withColumn(
        "check", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0)
    # about 2 * max_docs rows of three numbers, whatever the input
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "doc_id")

    names = ["n0", "n1", "m0", "m1"]      # ordinary and toxic, counted and calibrating documents
    schema = pa.schema([("gram", pa.int64()), *((c, pa.int64()) for c in names)])

    def count(batches):
        held: list[np.ndarray] = []
        kinds: list[np.ndarray] = []

        def flush():
            kind = np.concatenate(kinds)
            distinct, _, sums = _sums(np.concatenate(held), *(kind == k for k in range(4)))
            held.clear(), kinds.clear()
            return pa.record_batch([pa.array(distinct.view(np.int64)), *(pa.array(n.astype(np.int64)) for n in sums)],
                                   schema=schema)

        for batch in batches:
            for block in blocks(batch, "text"):
                g = grams(block.column("text"))
                held.append(g.keys[g.inside()])
                kinds.append(np.repeat(block.column("kind").to_numpy().astype(np.int8), g.counts))
                if sum(map(len, held)) > 2_000_000:
                    yield flush()
        if held:
            yield flush()

    kind = (F.col("toxic") + 2 * F.col("check").cast("int")).alias("kind")
    counted = (texts.select("text", kind).mapInArrow(count, "gram long, " + ", ".join(f"{c} long" for c in names))
               .groupBy("gram").agg(*(F.sum(c).alias(c) for c in names)))
    table = counted.toArrow()                    # the n-grams of the bounded sample
    keys = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    n0, n1, m0, m1 = (table.column(i).to_numpy()[order].astype(float) for i in range(1, 5))
    if not (n0 + m0).any() or not (n1 + m1).any():
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(np.log(n[1] / n[0])))
    final = ToxicityModel(keys, kneser_ney_ratios(keys, n0 + m0, n1 + m1))
    part_keys = (n0 + n1) > 0
    model = ToxicityModel(keys[part_keys], kneser_ney_ratios(keys[part_keys], n0[part_keys], n1[part_keys]))

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            for block in blocks(batch, "text"):
                yield pa.record_batch([pa.array(sent.value.worst_windows(block.column("text"))),
                                       block.column("toxic")], ["x", "toxic"])

    seen = texts.where("check").select("text", "toxic").mapInArrow(measure, "x double, toxic int").toArrow()
    x, y = seen.column(0).to_numpy(), seen.column(1).to_numpy().astype(float)
    if len(set(y.tolist())) == 2:
        final.slope, final.offset = _logistic(x, y, np.where(y == 1, 1 / part[1], 1 / part[0]))
    return final


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3, score_col: str = "toxic_score", predicted_col: str = "toxic_predicted") -> DataFrame:
    """All columns of ``docs`` plus ``score_col`` (0 to 1) and ``predicted_col`` (0/1).

    A null or empty text scores as a text without evidence, a text shorter than a window by its
    own length. Repeated rows score alike; ids are not read. An empty table gives an empty result.
    Existing columns of the two names are replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(score_col, predicted_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for block in blocks(batch, text_col):
                score = sent.value.scores(block.column(at))
                yield pa.record_batch([*block.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                      [*block.schema.names, score_col, predicted_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()),
                           T.StructField(predicted_col, T.IntegerType())])
    return docs.mapInArrow(run, schema)
