"""Fixed-size summaries of the whole input: a count sketch and an id filter.

The count sketch counts 64-bit fingerprints.

Each map task adds its fingerprints to ``2**bits`` counters; the counters are summed block by
block on the executors and the one summed table (4 bytes a counter, whatever the input) is sent
to all tasks. It only orders fingerprints from rare to frequent: a shared counter can make a
rare one look more frequent, which costs time and never changes a result.

The id filter is a bit table of ids. It lets a scan drop most rows before a join by id; it never
drops a listed id, and the join that follows decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from farelens.llm.words import mix

SKETCH_BLOCKS = 64
SKETCH_SCHEMA = "block int, counts binary"
_ARROW = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


class CountSketch:
    """Counters of one task."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.counts = np.zeros(1 << bits, np.uint32)
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray) -> None:
        self.pending.append((hashes >> self.shift).astype(np.int32))
        self.held += len(hashes)
        if self.held >= len(self.counts) // 2:
            self._fold()

    def _fold(self) -> None:
        if self.pending:
            at, n = np.unique(np.concatenate(self.pending), return_counts=True)
            self.counts[at] += n.astype(np.uint32)
        self.pending, self.held = [], 0

    def packed(self) -> Iterator[tuple[int, bytes]]:
        self._fold()
        compress = zstandard.ZstdCompressor(level=1).compress
        for i, part in enumerate(np.split(self.counts, SKETCH_BLOCKS)):
            yield i, compress(part.tobytes())


def sum_sketch(partials: DataFrame, bits: int) -> np.ndarray:
    """Sum the ``(block, counts)`` rows of all tasks; returns ``2**bits`` saturated uint32."""

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32)
                if b in sums:
                    sums[b] += part
                else:
                    sums[b] = part.astype(np.uint64)
        for b, total in sums.items():
            total = np.minimum(total, 2**32 - 1).astype(np.uint32)
            yield pa.record_batch([pa.array([b], pa.int32()),
                                   pa.array([zstandard.compress(total.tobytes())], pa.binary())], _ARROW)

    out = np.zeros(1 << bits, np.uint32)
    width = len(out) // SKETCH_BLOCKS
    parts = partials.select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(add_up, SKETCH_SCHEMA)
    for row in parts.collect():      # SKETCH_BLOCKS rows of fixed size
        out[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(
            zstandard.decompress(bytes(row["counts"])), np.uint32)
    return out


FILTER_BITS = 26


def _filter_slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(64 - FILTER_BITS)).astype(np.int64),
            (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64))


def _set_bits(table: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bit table (``2**FILTER_BITS`` bits, two per id) of a one-column table of long ids."""

    def mark(batches):
        table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            for at in _filter_slots(batch.column(0).to_numpy()):
                _set_bits(table, at)
        for i, part in enumerate(np.split(table, SKETCH_BLOCKS)):
            if part.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())],
                                      _ARROW)

    def unite(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zstandard.decompress(c), np.uint8)
                tables[b] = tables[b] | part if b in tables else part
        for b, t in tables.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([zstandard.compress(t.tobytes(), 1)], pa.binary())], _ARROW)

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = len(out) // SKETCH_BLOCKS
    parts = ids.mapInArrow(mark, SKETCH_SCHEMA).repartition(SKETCH_BLOCKS, "block").mapInArrow(unite, SKETCH_SCHEMA)
    for row in parts.collect():      # SKETCH_BLOCKS rows of fixed size
        out[row["block"] * width:(row["block"] + 1) * width] = np.frombuffer(
            zstandard.decompress(bytes(row["counts"])), np.uint8)
    return out


def maybe_listed_ids(table: np.ndarray, ids: pa.Array) -> pa.BooleanArray:
    """Which ids may be listed in the filter; a null id never is."""
    ok = ids.is_valid().to_numpy(zero_copy_only=False).copy()
    for slot in _filter_slots(ids.fill_null(0).to_numpy()):
        ok &= (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return pa.array(ok)


def maybe_listed(rows: DataFrame, id_col: str, table: np.ndarray, keep: bool = True) -> DataFrame:
    """Rows whose id may be listed in the filter, or with ``keep=False`` the others (null ids too)."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(id_col)

    def choose(batches):
        for batch in batches:
            ok = maybe_listed_ids(sent.value, batch.column(at))
            yield batch.filter(ok if keep else pc.invert(ok))

    return rows.mapInArrow(choose, rows.schema)
