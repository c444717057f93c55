"""Distinct word shingles of documents as sorted 64-bit fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from farelens.llm.words import find_words, fold_hash, run_hashes


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text (A-Z lower-cased).

    A text of one to ``k - 1`` words has its whole word sequence as its one shingle; a text
    without words has none.
    """
    words = find_words(texts, lower=True)
    hashes = words.hashes()
    runs = run_hashes(hashes, k)
    bounds = words.first.tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            s = np.sort(runs[a:b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(np.array([fold_hash(hashes[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_signature(values: np.ndarray) -> bytes:
    """128-bit signature of a sorted set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
