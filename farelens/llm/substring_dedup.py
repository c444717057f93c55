"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash
among its runs of ``seed`` words; consecutive windows with the same minimiser overlap in all but
one word each, so they travel as one packed string (a super-k-mer) to the bucket of that
minimiser. Equal windows have equal minimisers and meet in one bucket, where windows are sorted
by fingerprint, compared byte for byte, and every window but the earliest is a repeat.

Scale: a string that a map task has seen before is sent once with the list of its places, so a
passage held by a third of all rows costs one text per map task. The number of buckets follows the
input; buckets of a partition are sorted by Spark and worked one at a time. A minimiser that very many
windows share (a line of boilerplate with ever new neighbours) would make one bucket too large: a
count sketch of the windows of each minimiser, of fixed size, finds it, and its windows travel one by one
to the bucket of their own hash instead, where equal windows meet all the same. The repeated ranges
are written to the shared folder, then joined to the texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from farelens.llm.frequency import (SKETCH_BLOCKS, SKETCH_SCHEMA, CountSketch, id_filter, maybe_listed, maybe_listed_ids,
                                    sum_sketch)
from farelens.llm.scratch import bound_batches, shuffle_partitions, write_once
from farelens.llm.words import Words, blocks, find_words, mix, release, replace_text, run_hashes, with_text

_BUCKET_SCHEMA = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("packed", T.BinaryType())])
_RANGE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()),
                              T.StructField("ranges", T.BinaryType())])
_ARROW_BUCKET = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_ARROW_RANGE = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("ranges", pa.binary())])
FLUSH_BYTES = 8 << 20     # packed text that a map task holds
BUCKET_BYTES = 4 << 20    # packed text aimed at per bucket
PARTITION_BYTES = 32 << 20    # packed text aimed at per shuffle partition
HOT_BITS = 20             # slots of the count sketch of minimisers
HOT_WINDOWS = 1 << 20     # windows of a slot from which they travel one by one
COMPARED = 2 << 20        # bytes of windows compared at a time (one window at least)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    n, have, cur = len(x) - width + 1, 1, x
    while have * 2 <= width:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    return np.minimum(cur[:n], cur[width - have:width - have + n])


def _ranges_of(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive integers."""
    if not len(positions):
        return positions, positions
    cut = np.flatnonzero(np.diff(positions) != 1)
    return positions[np.concatenate([[0], cut + 1])], positions[np.concatenate([cut, [len(positions) - 1]])]


def _minimisers(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimiser, inside a document) of the window that starts at each word of a block."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least = _sliding_min(run_hashes(words.hashes(), seed), window - seed + 1)
    ok = np.zeros(len(least), bool)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= window:
            ok[a:b - window + 1] = True
    return least, ok


def _super_kmers(words: Words, window: int, seed: int, buckets: int, hot: np.ndarray | None):
    """(first word, last word, bucket) of every super-k-mer of a block; windows of ``hot`` minimisers are one each."""
    first = words.first[:-1]
    least, ok = _minimisers(words, window, seed)
    if not len(least):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    alone = np.zeros(len(least), bool) if hot is None else hot[(least >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
    start = ok.copy()
    start[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | alone[1:]
    doc_start = first[first < len(ok)]
    start[doc_start] |= ok[doc_start]
    begins = np.flatnonzero(start)
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | start[1:]
    ends = np.flatnonzero(stop)
    key = least[begins]
    if alone.any():
        single = alone[begins]
        key[single] = run_hashes(words.hashes(), window)[begins[single]]
    return begins, ends + window - 1, (mix(key) % np.uint64(buckets)).astype(np.int64)


def hot_minimisers(texts: DataFrame, window: int, seed: int, most: int = HOT_WINDOWS) -> np.ndarray | None:
    """Slots of minimisers whose windows travel alone: more than ``most``, and than eight times the mean slot."""
    def count(batches):
        sketch = CountSketch(HOT_BITS)
        for batch in batches:
            for block in blocks(batch, "text"):
                least, ok = _minimisers(find_words(block.column("text")), window, seed)
                sketch.add(least[ok])
        for i, packed in sketch.packed():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])

    assert (1 << HOT_BITS) % SKETCH_BLOCKS == 0
    slots = sum_sketch(texts.mapInArrow(count, SKETCH_SCHEMA), HOT_BITS)
    hot = slots > max(most, 8 * int(slots.mean()))
    return hot if hot.any() else None


class _Packer:
    """Collects super-k-mers of a task; equal strings are kept once with all their places."""

    def __init__(self):
        self.texts: dict[tuple[int, bytes], int] = {}
        self.bytes = 0
        self.places: list[np.ndarray] = []
        self.compress = zstandard.ZstdCompressor(level=1).compress

    def add(self, words: Words, begins, ends, bucket, ids: np.ndarray, fps: np.ndarray):
        if not len(begins):
            return
        data = words.data.tobytes()
        lo, hi = words.starts[begins].tolist(), words.ends[ends].tolist()
        number = np.empty(len(begins), np.int64)
        texts = self.texts
        for i, (b, a, z) in enumerate(zip(bucket.tolist(), lo, hi)):
            number[i] = texts.setdefault((b, data[a:z]), len(texts))
        self.bytes += sum(hi) - sum(lo)
        doc = np.searchsorted(words.first, begins, side="right") - 1
        self.places.append(np.stack([number, ids[doc], fps[doc], begins - words.first[doc]]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.texts:
            return
        keys = list(self.texts)
        bucket_of = np.array([k[0] for k in keys], np.int64)
        places = np.concatenate(self.places, axis=1)
        texts_by = np.argsort(bucket_of, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[texts_by] = np.arange(len(keys))
        place_bucket = bucket_of[places[0]]
        order = np.lexsort((rank[places[0]], place_bucket))
        places, place_bucket = places[:, order], place_bucket[order]
        sorted_bucket = bucket_of[texts_by]
        used, t_lo = np.unique(sorted_bucket, return_index=True)
        t_hi = np.append(t_lo[1:], len(keys))
        p_lo, p_hi = np.searchsorted(place_bucket, used), np.searchsorted(place_bucket, used, side="right")
        for b, t0, t1, p0, p1 in zip(used.tolist(), t_lo.tolist(), t_hi.tolist(), p_lo.tolist(), p_hi.tolist()):
            own = b"\n".join(keys[i][1] for i in texts_by[t0:t1].tolist())
            where = places[:, p0:p1].copy()
            where[0] = rank[where[0]] - t0
            head = np.array([t1 - t0, p1 - p0], np.int64).tobytes()
            yield pa.record_batch([pa.array([b], pa.int32()),
                                   pa.array([self.compress(head + where.tobytes() + own)], pa.binary())], _ARROW_BUCKET)
        self.__init__()


def _unpack(blobs: list[bytes]):
    """(texts joined by line feeds, text number, doc id, fingerprint, start) of a bucket."""
    texts, number, rest, base = [], [], [], 0
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n_texts, n_places = np.frombuffer(raw, np.int64, 2).tolist()
        where = np.frombuffer(raw, np.int64, 4 * n_places, 16).reshape(4, n_places)
        texts.append(raw[16 + 32 * n_places:])
        number.append(where[0] + base)
        rest.append(where[1:])
        base += n_texts
    doc, fp, start = np.concatenate(rest, axis=1)
    return b"\n".join(texts), np.concatenate(number), doc, fp, start


def _windows(data: bytes, window: int):
    """Per window of the joined texts: fingerprint, text number, offset in words, byte span."""
    texts = pa.array(data.split(b"\n"), pa.large_binary()).cast(pa.large_string())
    batch = pa.record_batch([texts], ["text"])
    key, text, within, lo, hi = [], [], [], [], []
    n_texts = base = 0
    for block in blocks(batch, "text"):
        words = find_words(block.column("text"))
        n = np.diff(words.first) - window + 1
        of = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = words.first[of] + off
        key.append(run_hashes(words.hashes(), window)[at])
        text.append((of + n_texts).astype(np.int32))
        within.append(off.astype(np.int32))
        lo.append((words.starts[at] + base).astype(np.int32))      # the texts of a bucket stay far below 2 GB
        hi.append((words.ends[at + window - 1] + base).astype(np.int32))
        n_texts += len(n)
        base += len(words.data)
    return [np.concatenate(x) for x in (key, text, within, lo, hi)]


def _any_differs(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> bool:
    """Is any window other than the window before it of the same group? About ``COMPARED`` bytes are compared at a time."""
    pairs = np.flatnonzero(group[1:] == group[:-1]) + 1
    size = (hi - lo).astype(np.int64)
    if (size[pairs] != size[pairs - 1]).any():
        return True
    part = np.cumsum(size[pairs]) // COMPARED
    for now in np.split(pairs, np.flatnonzero(np.diff(part)) + 1):
        n = size[now]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(lo[now], n) + within] != data[np.repeat(lo[now - 1], n) + within]).any():
            return True
    return False


def _repeats(blobs: list[bytes], window: int) -> pa.RecordBatch | None:
    """Word ranges covered by windows of the bucket that also start earlier."""
    data, number, doc, fp, start = _unpack(blobs)
    order = np.lexsort((start, fp, doc, number))
    number, doc, fp, start = number[order], doc[order], fp[order], start[order]
    leads = np.flatnonzero(np.diff(number, prepend=-1))
    key, text_of, within, lo, hi = _windows(data, window)
    n_windows = np.bincount(text_of, minlength=len(leads))
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    repeated = np.zeros(len(by), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    by = by[repeated]
    lead = leads[text_of[by]]
    # Equal fingerprints only propose; groups are told apart by the bytes of the windows.
    key, spans = key[by], (lo[by], hi[by])
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(by) else np.zeros(0, np.int64)
    if _any_differs(np.frombuffer(data, np.uint8), *spans, group):
        exact = {}
        group = np.array([exact.setdefault((g, data[a:z]), len(exact)) for g, a, z in zip(group.tolist(), *map(np.ndarray.tolist, spans))])
    place = start[lead] + within[by]
    rank = np.lexsort((place, fp[lead], doc[lead], group))
    g = group[rank]
    # the first place of a group seen again (rows repeated in the input) is one window, not a repeat of itself
    new = np.diff(g, prepend=-1) != 0
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    d, f, p = doc[lead][rank], fp[lead][rank], place[rank]
    not_first = (d != d[head]) | (f != f[head]) | (p != p[head])
    late = np.sort(by[rank][not_first])
    run_lo, run_hi = _ranges_of(late + text_of[late])       # a gap between texts separates their runs
    t = text_of[late][np.searchsorted(late + text_of[late], run_lo)] if len(late) else run_lo
    first_window = np.cumsum(n_windows) - n_windows
    run_lo, run_hi = run_lo - t - first_window[t], run_hi - t - first_window[t]
    # Places of a text after its first are repeats throughout, unless they are that same place again.
    lead_of = leads[number]
    moved = (doc != doc[lead_of]) | (fp != fp[lead_of]) | (start != start[lead_of])
    out_doc = np.concatenate([doc[leads[t]], doc[moved]])
    out_fp = np.concatenate([fp[leads[t]], fp[moved]])
    out_lo = np.concatenate([start[leads[t]] + run_lo, start[moved]])
    out_hi = np.concatenate([start[leads[t]] + run_hi + window, start[moved] + n_windows[number[moved]] - 1 + window])
    if not len(out_doc):
        return None
    order = np.lexsort((out_lo, out_fp, out_doc))
    out_doc, out_fp = out_doc[order], out_fp[order]
    pairs = np.stack([out_lo[order], out_hi[order]], axis=1).astype("<i4")
    new = np.flatnonzero((np.diff(out_doc, prepend=out_doc[0] - 1) != 0) | (np.diff(out_fp, prepend=out_fp[0]) != 0))
    cuts = np.append(new, len(out_doc)).tolist()
    return pa.record_batch([pa.array(out_doc[new]), pa.array(out_fp[new]),
                            pa.array([pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                           _ARROW_RANGE)


def repeated_ranges(docs: DataFrame, window: int = 20, seed: int = 4, buckets: int | None = None,
                    hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """``(doc_id, fp, ranges)``: packed int32 pairs (first word, word after the last) of repeats.

    ``docs`` has ``doc_id``, ``fp`` and ``text``. Rows with a null id take no part.
    """
    if not 1 <= seed <= window:
        raise ValueError("seed must lie between 1 and window")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "fp", "text")
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] * 3
    if buckets is None:
        buckets = max(shuffle_partitions(spark), int(held // BUCKET_BYTES) + 1)
    hot = hot_minimisers(docs.select("text"), window, seed, hot_windows)
    sent = spark.sparkContext.broadcast(hot)             # 2 ** HOT_BITS flags, whatever the input

    def pack(batches):
        packer = _Packer()
        for batch in batches:
            for block in blocks(batch, "text"):
                words = find_words(block.column("text"))
                packer.add(words, *_super_kmers(words, window, seed, buckets, sent.value),
                           block.column("doc_id").to_numpy(), block.column("fp").to_numpy())
                if packer.bytes >= FLUSH_BYTES:
                    yield from packer.flush()
        yield from packer.flush()

    def unpack(batches):
        bucket, waiting = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket:
                    if waiting and (out := _repeats(waiting, window)) is not None:
                        yield out
                    bucket, waiting = b, []
                    release()
                waiting.append(blob)
        if waiting and (out := _repeats(waiting, window)) is not None:
            yield out
        release()

    partitions = min(buckets, max(shuffle_partitions(spark), int(held // PARTITION_BYTES) + 1))
    packed = docs.mapInArrow(pack, _BUCKET_SCHEMA).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(unpack, _RANGE_SCHEMA)


def _merge_ranges(first: np.ndarray, packed: list) -> np.ndarray:
    """Removed-word mask of a block from the packed ranges of its documents."""
    step = np.zeros(int(first[-1]) + 1, np.int32)
    for base, blobs in zip(first[:-1].tolist(), packed):
        for blob in blobs or ():
            pairs = np.frombuffer(blob, "<i4").reshape(-1, 2)
            np.add.at(step, base + pairs[:, 0], 1)
            np.add.at(step, base + pairs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _keep_words(words: Words, removed: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Kept words of each document joined by one space, and their number."""
    lengths = words.ends - words.starts + 1
    kept = words.data[np.repeat(~removed, lengths)]
    size = np.concatenate([[0], np.cumsum(np.where(removed, 0, lengths))])[words.first]
    count = np.concatenate([[0], np.cumsum(~removed)])[words.first]
    kept_bytes = kept.tobytes()
    bounds = size.tolist()
    return [kept_bytes[a:max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])], np.diff(count)


def _rewrite(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, buckets: int | None,
             report: bool) -> DataFrame:
    row = F.struct(F.col(text_col).alias("text")) if report else F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    at = 0 if report else docs.columns.index(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("fp"),
                       F.col(text_col).alias("text"), row.alias("row"))
    found = write_once(repeated_ranges(base, window, seed, buckets), "repeated-windows")
    per_doc = found.groupBy("doc_id", "fp").agg(F.collect_list("ranges").alias("ranges"))
    # only documents that may be listed are shuffled to meet their repeats; the others are done at once. The hint keeps
    # a shuffle between the two Python steps: in one task they would hold two workers
    table = id_filter(per_doc.select("doc_id"))
    rows = base.select("doc_id", "fp", "row")
    listed = maybe_listed(rows, "doc_id", table).join(per_doc.hint("merge"), ["doc_id", "fp"], "left").select("doc_id", "ranges", "row")
    others = rows.select("doc_id", F.lit(None).cast("array<binary>").alias("ranges"), "row")
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def apply_others(batches):
        return apply(b.filter(pc.invert(maybe_listed_ids(sent.value, b.column(0)))) for b in batches)

    def apply(batches):
        for batch in batches:
            for block in blocks(with_text(batch, 2, at), "text"):
                words = find_words(block.column("text"))
                removed = _merge_ranges(words.first, block.column("ranges").to_pylist())
                texts, kept = _keep_words(words, removed)
                n = np.diff(words.first)
                if report:
                    yield pa.record_batch([block.column("doc_id"), pa.array(n), pa.array(n - kept),
                                           pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                                          ["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    yield pa.record_batch([replace_text(block.column("row"), at, n != kept, texts)], ["row"])

    if report:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
        return listed.mapInArrow(apply, schema).unionByName(others.mapInArrow(apply_others, schema))
    schema = T.StructType([T.StructField("row", base.schema["row"].dataType)])
    return listed.mapInArrow(apply, schema).unionByName(others.mapInArrow(apply_others, schema)).select("row.*")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    seed: int = 4, buckets: int | None = None) -> DataFrame:
    """``docs`` without the words covered by a window whose word sequence also starts earlier.

    Earlier means a smaller id, or the same document and an earlier start; windows are judged on
    the input. A document that loses words holds its other words joined by one space; any other
    keeps its text unchanged. Columns and rows stay as they are.

    Defined cases: a null or empty text has no words and stays; a text shorter than the window is
    kept; a row with a null id is never judged and kept whole; rows equal in id and text count as
    one document (neither removes the other); rows that share an id but not the text are ordered by
    a hash of the text; an empty table gives an empty result; other columns may have any name.
    """
    return _rewrite(docs, id_col, text_col, window, seed, buckets, report=False)


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                     seed: int = 4, buckets: int | None = None) -> DataFrame:
    """What ``substring_dedup`` keeps, per row: ``doc_id``, ``n_words``, ``n_removed`` and
    ``kept_sha256`` (of the kept words joined by one space, in UTF-8)."""
    return _rewrite(docs, id_col, text_col, window, seed, buckets, report=True)
