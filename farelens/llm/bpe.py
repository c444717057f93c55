"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Each word keeps one leaf per symbol with the rank of the pair that starts there, and a tree of
minima above; the root names the lowest rank and, on ties, the leftmost pair. A merge changes at
most three leaves, whose paths are updated level by level, until the root holds no pair. Words of
like length are merged together as rows of the same arrays, and each distinct word is merged once
per task at most; the texts themselves stay in their partitions, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from farelens.llm.words import blocks

CACHED_WORDS = 250_000
_NO_PAIR = np.iinfo(np.int64).max
_ROWS = 1 << 15                      # symbols merged together
_WHITE_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take the code points
    from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    spare = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chr(b) if b not in spare else spare[b] for b in range(256)]


class BpeModel:
    """Vocabulary, merges and text preparation read from a tokenizer file."""

    def __init__(self, spec: bytes):
        t = json.loads(spec)
        model = t["model"]
        steps = (t.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or t.get("decoder") \
                or t.get("post_processor") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only byte-level BPE files without decoder and post-processor are supported")
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in t["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        kinds = [s["type"] for s in (t.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only the NFC, white space, lower case normaliser is supported")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first_ids = np.array([vocab[c] for c in symbols], np.int64)
        self.last_ids = np.array([vocab[c + suffix] for c in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {a["content"]: a["id"] for a in t["added_tokens"]}
        self.token = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        pattern = steps[0]["pattern"]["Regex"].replace(r"\s", _WHITE_SPACE)
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")).findall
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        for s, i in self.special.items():
            self._learn_special(s, i)

    def _learn_special(self, s: str, i: int) -> None:
        self.ids["\0" + s], self.text["\0" + s] = np.array([i], "<u4").tobytes(), s

    def words(self, text: str) -> list[str]:
        """Words of a text after normalising; an added token appears with a leading NUL."""
        if self.split_special and self.split_special.search(text):
            out = []
            for i, part in enumerate(self.split_special.split(text)):
                out += ["\0" + part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.find(text.replace("Σ", "σ").lower())

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_rows(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of symbols (width a power of two); returns (ids, alive mask)."""
        rows, width = ids.shape
        ids = ids.ravel().copy()
        column = np.arange(width)
        inside = column[None, :] < length[:, None]
        alive = inside.copy().ravel()
        after = np.where(inside[:, 1:], column[1:], -1)
        after = np.concatenate([after, np.full((rows, 1), -1)], axis=1).ravel()
        before = np.broadcast_to(column - 1, (rows, width)).copy().ravel()

        def leaf(rank, col):
            return np.where(rank < 0, _NO_PAIR, rank * width + col)

        pairs = np.flatnonzero(after >= 0)
        bottom = np.full(rows * width, _NO_PAIR, np.int64)
        bottom[pairs] = leaf(self._ranks(ids[pairs], ids[pairs + 1]), pairs % width)
        tree = [bottom]
        while len(tree[-1]) > rows:
            tree.append(np.minimum(tree[-1][0::2], tree[-1][1::2]))

        def put(at, value):
            tree[0][at] = value
            for low, high in zip(tree[:-1], tree[1:]):
                at = at >> 1
                high[at] = np.minimum(low[2 * at], low[2 * at + 1])

        row = np.flatnonzero(tree[-1] != _NO_PAIR)
        while len(row):
            root = tree[-1][row]
            rank, col = root // width, root % width
            base = row * width
            here = base + col
            gone = base + after[here]
            ids[here] = self.merged[rank]
            alive[gone] = False
            follow = after[gone]
            after[here] = follow
            more = follow >= 0
            before[(base + follow)[more]] = col[more]
            put(gone, _NO_PAIR)
            value = np.full(len(row), _NO_PAIR, np.int64)
            value[more] = leaf(self._ranks(ids[here[more]], ids[(base + follow)[more]]), col[more])
            put(here, value)
            prior = before[here]
            some = prior >= 0
            left = (base + prior)[some]
            put(left, leaf(self._ranks(ids[left], ids[here[some]]), prior[some]))
            row = row[tree[-1][row] != _NO_PAIR]
        return ids, alive

    def learn(self, words) -> None:
        """Encode words that the task has not met; the memory forgets all when it is full."""
        if len(self.ids) + len(words) > CACHED_WORDS:
            self.ids.clear(), self.text.clear()
            for s, i in self.special.items():
                self._learn_special(s, i)
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((w, b))
        for width, group in by_width.items():
            step = max(1, _ROWS // width)
            for k in range(0, len(group), step):
                part = group[k:k + step]
                length = np.array([len(b) for _, b in part])
                raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for _, b in part), np.uint8).reshape(-1, width)
                ids = self.first_ids[raw]
                end = (np.arange(len(part)), length - 1)
                ids[end] = self.last_ids[raw[end]]
                ids, alive = self.merge_rows(ids, length)
                flat = ids[alive].astype("<u4")
                ends = np.cumsum(alive.reshape(-1, width).sum(axis=1)).tolist()
                packed, start = flat.tobytes(), 0
                names = list(map(self.token.__getitem__, flat.tolist()))
                for (w, _), z in zip(part, ends):
                    self.ids[w] = packed[4 * start:4 * z]
                    self.text[w] = " ".join(names[start:z])
                    start = z

    def encode_block(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(little-endian uint32 ids, decoded text) of each text."""
        split = [self.words(t) for t in texts]
        wanted = set().union(*split)
        if len(wanted) + len(self.special) > CACHED_WORDS:      # more than the memory holds: text by text, part by part
            return [x for t in texts for x in self.encode_block([t])] if len(texts) > 1 else self._in_parts(split[0])
        while new := wanted.difference(self.ids):               # once more if learning has made room
            self.learn(new)
        ids, text = self.ids.__getitem__, self.text.__getitem__
        return [(b"".join(map(ids, w)), " ".join(map(text, w))) for w in split]

    def _in_parts(self, words: list[str]) -> list[tuple[bytes, str]]:
        ids, text = [], []
        step = max(1, (CACHED_WORDS - len(self.special)) // 2)
        for k in range(0, len(words), step):
            part = words[k:k + step]
            while new := set(part).difference(self.ids):
                self.learn(new)
            ids += map(self.ids.__getitem__, part)
            text += map(self.text.__getitem__, part)
        return [(b"".join(ids), " ".join(text))]


_models: dict[str, BpeModel] = {}


def _model(spec: bytes) -> BpeModel:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = BpeModel(spec)
    return _models[key]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   rewrite: bool = True) -> DataFrame:
    """Encode each text to token ids and decode the ids again.

    Returns the id with ``n_tokens`` (long), ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` (of the decoded text in UTF-8); with ``rewrite`` also
    ``ids`` (array<int>) and ``decoded``. ``tokenizer_path`` is read by the driver and its content
    is sent to the tasks. Added tokens that occur in a text are encoded as themselves; decoding
    joins the token strings by one space, as for a file without a decoder. Letters and numbers are
    those of the ``regex`` module's Unicode version.

    Defined cases: a null or empty text has no tokens and decodes to the empty text; rows are
    independent, so repeated rows, null ids and ties need no rule; other columns are not read.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    BpeModel(content)
    spec = docs.sparkSession.sparkContext.broadcast(content)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if rewrite:
        names += ["ids", "decoded"]
        schema += ", ids array<int>, decoded string"

    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            for block in blocks(batch, "text"):
                out = model.encode_block([t or "" for t in block.column("text").to_pylist()])
                cols = [block.column("doc_id"), pa.array([len(i) // 4 for i, _ in out], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in out], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in out], pa.string())]
                if rewrite:
                    cols += [pa.array([np.frombuffer(i, "<i4") for i, _ in out], pa.list_(pa.int32())),
                             pa.array([t for _, t in out], pa.string())]
                yield pa.record_batch(cols, names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, schema)
