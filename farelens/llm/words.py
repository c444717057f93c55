"""Words, lines and 64-bit fingerprints of Arrow text columns, vectorised over byte buffers.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``; those bytes never occur
inside a multi-byte UTF-8 character, so the work is done on bytes. Texts are taken in blocks of
whole documents of about ``BLOCK_BYTES``, which bounds the working memory of a task by the
longest document plus one block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
TABLE = 1 << 19        # entries of the tables that a worker keeps

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; kept up to ``TABLE`` of them, longer ones made for the call."""
    global _powers, _inverse_powers
    if len(_powers) >= n:
        return _powers, _inverse_powers
    size = 1 << int(n - 1).bit_length()
    step, back = np.full(size, _MULT, np.uint64), np.full(size, pow(_MULT, -1, 2**64), np.uint64)
    step[0] = back[0] = 1
    up, down = np.cumprod(step), np.cumprod(back)
    if size <= TABLE:
        _powers, _inverse_powers = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span: polynomial prefix sums modulo 2**64, then a finaliser.

    Spans must ascend. A hash does not depend on where its span lies, so long data is taken in pieces.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + TABLE - 1, side="right")))
        part = data[base:ends[j - 1]]
        n = len(part)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[part] * up[:n], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (``len(values) - k + 1`` of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= np.uint64(0x9DDFEA08EB382D69)
        acc += values[j:j + n]
    return mix(acc)


def fold_hash(values: np.ndarray) -> int:
    """Order-sensitive hash of a whole sequence of 64-bit values."""
    total, factor = len(values), 1
    up, _ = _power_tables(TABLE)
    for a in range(0, len(values), TABLE):
        part = values[a:a + TABLE]
        total += int((part * up[:len(part)]).sum(dtype=np.uint64)) * factor
        factor = factor * pow(_MULT, len(part), 2**64) % 2**64
    return int(mix(np.array([total % 2**64], np.uint64))[0])


def text_buffer(texts: pa.Array, closing: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty, ``closing`` is added to each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if closing:
        texts = pc.binary_join_element_wise(texts, pa.scalar(closing, pa.large_binary()),
                                            pa.scalar(b"", pa.large_binary()))
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


_settled = False


def _settle() -> None:
    """Once per worker: freed arrays of a MB or more go straight back to the system.

    Workers live on between stages, and what their allocators keep counts against the executor.
    """
    global _settled
    if _settled:
        return
    _settled = True
    pa.set_memory_pool(pa.system_memory_pool())
    if _libc is not None:
        for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):      # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            _libc.mallopt(option, value)


def _c_library():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "mallopt") and hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_libc = _c_library()


def release() -> None:
    """Hand memory that Arrow and numpy have freed back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding about ``size`` bytes of text each (one row at least)."""
    _settle()
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths.astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
    release()


@dataclass
class Words:
    """Words of a block: ``data`` holds every word followed by one space."""

    data: np.ndarray
    starts: np.ndarray    # byte offset of each word
    ends: np.ndarray      # byte offset after each word
    first: np.ndarray     # first word of each document, and the number of words at the end

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def find_words(texts: pa.Array, lower: bool = False) -> Words:
    """Split each text into words; ``lower`` maps A-Z to a-z only."""
    raw, off = text_buffer(texts, b" ")
    space = _SPACE[raw]
    after_word = np.zeros(len(raw), bool)
    after_word[1:] = space[1:] & ~space[:-1]
    keep = ~space | after_word
    data = raw[keep]
    if lower:
        data = _LOWER[data]
    ends = np.flatnonzero(space[keep])
    data[ends] = 0x20
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return Words(data, starts, ends, np.searchsorted(np.flatnonzero(after_word), off))


def with_text(batch: pa.RecordBatch, row: int, text: int) -> pa.RecordBatch:
    """The batch plus a column ``text``: field ``text`` of its struct column ``row`` (not nested nulls)."""
    return batch.append_column("text", batch.column(row).field(text))


def replace_text(rows: pa.StructArray, text: int, changed: np.ndarray, texts: list[bytes]) -> pa.StructArray:
    """Struct rows whose field ``text`` is replaced where ``changed``."""
    fields = [rows.type.field(i) for i in range(rows.type.num_fields)]
    values = [rows.field(i) for i in range(len(fields))]
    new = pa.array(texts, pa.large_binary() if pa.types.is_large_string(fields[text].type) else pa.binary())
    values[text] = pc.if_else(pa.array(changed), new.cast(fields[text].type), values[text])
    return pa.StructArray.from_arrays(values, fields=fields)
