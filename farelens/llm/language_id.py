"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a gated recurrent unit whose input weights are a column per byte; every
position is labelled by a linear layer over both directions' states, and a document's language is
the normalised geometric mean of its positions' probabilities. That mean equals the softmax of the
linear layer applied to the mean state, so scoring never forms the label matrix. Gates and states
use softsign, ``x / (1 + |x|)``, in place of the exponential curves.

Texts are cut into windows of ``STEPS`` bytes (all bytes of all texts); a window starts from the
zero state, in training and scoring alike, so thousands of windows advance as one matrix and a
long text needs no more memory than a short one. Training (numpy, backpropagation through time,
Adam) reads a bounded sample: about ``MAX_DOCS`` documents of each language and ``DOC_WINDOWS``
windows of each. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from farelens.llm.words import blocks, text_buffer

STEPS = 64
HIDDEN = 8
MAX_DOCS = 400
DOC_WINDOWS = 4
TRAIN_ROUNDS = 400
BATCH = 192
_COLUMNS = 4096        # windows advanced together

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _softsign(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    np.abs(x, out=room)
    room += 1
    np.divide(x, room, out=x)
    return x


class Direction:
    """One gated recurrent unit; arrays have one column per window."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.byte = (rng.standard_normal((3 * hidden, 256)) * 0.5).astype(np.float32)
        self.gates = (rng.standard_normal((2 * hidden, hidden)) * 0.4).astype(np.float32)
        self.state = (rng.standard_normal((hidden, hidden)) * 0.4).astype(np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.byte, self.gates, self.state]

    def sums(self, x: np.ndarray, tail: slice, tail_length: np.ndarray, reverse: bool) -> np.ndarray:
        """Sum of the states over the bytes of each window; ``x`` is (steps, windows)."""
        steps, n = x.shape
        hidden = len(self.state)
        h, total = np.zeros((hidden, n), np.float32), np.zeros((hidden, n), np.float32)
        inp, gate, cand = (np.empty((k * hidden, n), np.float32) for k in (3, 2, 1))
        room, gated = np.empty((2 * hidden, n), np.float32), np.empty((hidden, n), np.float32)
        for t in (range(steps - 1, -1, -1) if reverse else range(steps)):
            np.take(self.byte, x[t], axis=1, out=inp, mode="clip")
            np.matmul(self.gates, h, out=gate)
            gate += inp[:2 * hidden]
            _softsign(gate, room)
            gate += 1
            gate *= 0.5
            np.multiply(gate[hidden:], h, out=gated)
            np.matmul(self.state, gated, out=cand)
            cand += inp[2 * hidden:]
            _softsign(cand, room[:hidden])
            cand -= h
            cand *= gate[:hidden]
            h += cand
            total += h
            out = np.flatnonzero(tail_length <= t)
            if len(out):
                out += tail.start
                total[:, out] -= h[:, out]
        return total

    def forward(self, x: np.ndarray) -> dict:
        """States at every step, with what the backward pass needs."""
        steps, n = x.shape
        hidden = len(self.state)
        h = np.zeros((hidden, n), np.float32)
        kept = {"x": x, "before": [], "gate_abs": [], "gate": [], "gated": [], "cand": [], "cand_abs": [], "h": []}
        for t in range(steps):
            inp = self.byte[:, x[t]]
            a = self.gates @ h + inp[:2 * hidden]
            gate = 0.5 + 0.5 * a / (1 + np.abs(a))
            gated = gate[hidden:] * h
            c = self.state @ gated + inp[2 * hidden:]
            cand = c / (1 + np.abs(c))
            for k, v in (("before", h), ("gate_abs", np.abs(a)), ("gate", gate), ("gated", gated), ("cand", cand),
                         ("cand_abs", np.abs(c))):
                kept[k].append(v)
            h = h + gate[:hidden] * (cand - h)
            kept["h"].append(h)
        return kept

    def backward(self, kept: dict, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients through time; ``d_out`` is (steps, hidden, windows)."""
        hidden = len(self.state)
        steps, n = kept["x"].shape
        d_gates, d_state = np.zeros_like(self.gates), np.zeros_like(self.state)
        d_inp = np.empty((steps, 3 * hidden, n), np.float32)
        dh = np.zeros((hidden, n), np.float32)
        for t in range(steps - 1, -1, -1):
            dh = dh + d_out[t]
            before, gate, cand = kept["before"][t], kept["gate"][t], kept["cand"][t]
            update, reset = gate[:hidden], gate[hidden:]
            dc = dh * update / (1 + kept["cand_abs"][t]) ** 2
            d_gated = self.state.T @ dc
            d_state += dc @ kept["gated"][t].T
            da = np.concatenate([dh * (cand - before), d_gated * before]) * 0.5 / (1 + kept["gate_abs"][t]) ** 2
            d_gates += da @ before.T
            d_inp[t, :2 * hidden], d_inp[t, 2 * hidden:] = da, dc
            dh = dh * (1 - update) + d_gated * reset + self.gates.T @ da
        flat = d_inp.transpose(1, 0, 2).reshape(3 * hidden, -1)
        at = kept["x"].ravel()
        d_byte = np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32)
        return [d_byte, d_gates, d_state]


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all windows, length of each window, document of each window)."""
    raw, off = text_buffer(texts)
    length = np.diff(off)
    count = -(-length // STEPS)
    first = np.cumsum(count) - count
    out = np.full(int(count.sum()) * STEPS, 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(first * STEPS - off[:-1], length)] = _FOLD[raw]
    size = np.full(int(count.sum()), STEPS)
    some = count > 0
    size[(first + count - 1)[some]] = (length - (count - 1) * STEPS)[some]
    return out.reshape(-1, STEPS), size, np.repeat(np.arange(len(length)), count)


class LanguageModel:
    """A network and its languages (in sorted order)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = sorted(languages)
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = (rng.standard_normal((len(languages), 2 * hidden)) * 0.3).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = TRAIN_ROUNDS, rate: float = 0.02, seed: int = 9) -> None:
        """Per-position cross-entropy on windows ``x`` (n, steps) with language numbers ``y``."""
        rng = np.random.default_rng(seed)
        params = [*self.ahead.params(), *self.back.params(), self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        hidden = len(self.ahead.state)
        for k in range(rounds):
            pick = rng.integers(0, len(x), min(BATCH, len(x)))
            xb = x[pick].T.astype(np.intp)
            steps, n = xb.shape
            f, b = self.ahead.forward(xb), self.back.forward(xb[::-1])
            states = np.concatenate([np.stack(f["h"]), np.stack(b["h"])[::-1]], axis=1)
            logits = np.einsum("lh,thn->tln", self.out, states, optimize=True) + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[:, y[pick], np.arange(n)] -= 1
            p /= steps * n
            d_states = np.einsum("lh,tln->thn", self.out, p, optimize=True)
            grads = [*self.ahead.backward(f, d_states[:, :hidden]),
                     *self.back.backward(b, d_states[::-1, hidden:]),
                     np.einsum("tln,thn->lh", p, states, optimize=True), p.sum(axis=(0, 2))[:, None]]
            step = rate * (1 - 0.9 * k / rounds)
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= step * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(documents, languages); rows of texts without bytes are even."""
        x, size, doc = windows(texts)
        hidden = len(self.ahead.state)
        total = np.zeros((len(texts), 2 * hidden))
        order = np.concatenate([np.flatnonzero(size == STEPS), np.flatnonzero(size < STEPS)])
        for k in range(0, len(order), _COLUMNS):
            part = order[k:k + _COLUMNS]
            xb = np.ascontiguousarray(x[part].T).astype(np.intp)
            short = int(np.count_nonzero(size[part] < STEPS))
            tail = slice(len(part) - short, len(part))
            for j, d in ((0, self.ahead), (hidden, self.back)):
                sums = d.sums(xb, tail, size[part][tail], reverse=j > 0)
                for i in range(hidden):
                    total[:, j + i] += np.bincount(doc[part], sums[i], len(texts))
        count = np.bincount(doc, size, len(texts))[:, None]
        logits = (total / np.maximum(count, 1)) @ self.out.T.astype(float) + self.bias.T
        logits[count[:, 0] == 0] = 0
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 max_docs: int = MAX_DOCS, rounds: int = TRAIN_ROUNDS, doc_windows: int | None = DOC_WINDOWS) -> LanguageModel | None:
    """Train on documents whose ``crc32(id as text) mod 4`` is not 2 and whose language is not null.

    The sample is bounded twice: about ``max_docs`` documents of each language, and of each of them
    ``doc_windows`` windows spread evenly over the whole text (None: all windows; the number of rounds
    bounds the work then). Rows without a text or an id are left out. Returns None when nothing is left
    to learn from.
    """
    if doc_windows is not None and doc_windows < 1:
        raise ValueError("doc_windows must be positive")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"))
    base = base.where("doc_id is not null and text is not null and text <> '' and lang is not null").where(
        F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    counts = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for c in languages for v in (c, min(1.0, max_docs / counts[c]))])
    sample = base.where(draw < share[F.col("lang")]).select("doc_id", "text", "lang")

    def cut(batches):
        """Evenly spread windows of each sampled document, as training rows."""
        for batch in batches:
            for block in blocks(batch, "text"):
                x, size, doc = windows(block.column("text"))
                edge = np.searchsorted(doc, np.arange(block.num_rows + 1))
                pick, owner = [], []
                for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
                    take = np.unique(np.linspace(a, b - 1, b - a if doc_windows is None else min(doc_windows, b - a)).astype(int))
                    pick += take.tolist()
                    owner += [i] * len(take)
                yield pa.record_batch([block.column("doc_id").take(pa.array(owner, pa.int64())),
                                       block.column("lang").take(pa.array(owner, pa.int64())),
                                       pa.array(list(map(bytes, x[pick])), pa.binary())], ["doc_id", "lang", "window"])

    rows = sample.mapInArrow(cut, "doc_id long, lang string, window binary").toArrow()
    number = {c: i for i, c in enumerate(languages)}
    data = sorted(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(1).to_pylist()))
    model = LanguageModel(languages)
    if data:
        x = np.frombuffer(b"".join(w for _, w, _ in data), np.uint8).reshape(-1, STEPS)
        model.train(x, np.array([number[c] for _, _, c in data]), rounds)
    return model


def identify_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``lang_score`` (0 to 1).

    A text that is null or holds no letter is ``und`` with score 0, as is every text without a
    model. Of languages of equal probability the first by name is taken. Repeated rows score alike; an empty table gives an empty result; existing columns
    named ``lang_pred`` or ``lang_score`` are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = sent.value
        for batch in batches:
            for block in blocks(batch, text_col):
                texts = block.column(at)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
                if net is None:
                    names, best = pa.array(["und"] * len(texts)), np.zeros(len(texts))
                else:
                    p = net.probabilities(texts)
                    names = pa.array([net.languages[i] for i in p.argmax(axis=1)], pa.string())
                    names = pc.if_else(letters, names, "und")
                    best = np.where(letters.to_numpy(zero_copy_only=False), p.max(axis=1), 0.0)
                yield pa.record_batch([*block.columns, names, pa.array(best)],
                                      [*block.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
