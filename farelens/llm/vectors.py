"""Shared handling of embedding columns: valid vectors, classes of equal vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def valid_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part and their vectors in double precision.

    A vector takes part unless it is null or empty, holds a null or non-finite component, or is
    zero (its norm in double precision is 0 or not finite).
    """
    if not len(column):
        return np.zeros(0, np.int64), []
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    bad = ~pc.is_valid(flat).to_numpy(zero_copy_only=False)
    values = np.where(bad, np.nan, pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths)
    rows, out = [], []
    with np.errstate(over="ignore", invalid="ignore"):
        for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
            v = values[a:b]
            n = np.sqrt(np.dot(v, v)) if b > a else 0.0
            if n > 0 and np.isfinite(n):
                rows.append(i)
                out.append(v)
    return np.array(rows, np.int64), out


def vector_key(v: np.ndarray) -> bytes:
    """128-bit fingerprint of a vector (negative zero counts as zero)."""
    return hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest()


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
