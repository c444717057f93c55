"""Variable-capacity best-fit packing of token pieces into sequences.

Pieces are packed longest first. Each goes into the open sequence that it leaves fullest; when
none has room, a new one is opened at the permitted length of least cost per packed token, judged
by filling each length with what is still to come. At the end every sequence is downsized to the
shortest permitted length that holds its contents.

Pieces of equal length are interchangeable, so the whole plan follows from the histogram of
lengths, which has at most ``max(capacities)`` rows whatever the input. The plan is made once from
that histogram, as runs of equal placements; its size depends on the lengths and not on the number
of documents. Spark then ranks the pieces within their length (range partitions and offsets, so a
length that holds a third of all pieces is spread over many tasks) and looks each rank up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from farelens.llm.bpe import _model as bpe_model
from farelens.llm.scratch import shuffle_partitions, write_once
from farelens.llm.words import blocks, find_words

CAPACITIES = (512, 1024, 2048, 4096)
SEQUENCE_COST = 16          # cost of a sequence besides its length


@dataclass
class Plan:
    """Runs of placements ``(length, rank, count, per bin, first bin, offset)`` and final bins."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)      # (first bin, count, content)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        bins = np.array(sorted(self.bins), np.int64).reshape(-1, 3)
        return runs, bins


def cheapest_capacity(length: int, capacities, counts: dict[int, int], lengths: list[int], overhead: int) -> int:
    """Permitted length of least cost per token for a sequence opened by a piece of ``length``.

    Each candidate is filled with pieces of this length and then, greedily, with the longest of
    the shorter ``lengths`` (ascending; ``counts`` of each); it costs the permitted length that
    its contents need in the end, plus ``overhead``. Ties go to the shorter length.
    """
    best = None
    for c in capacities:
        if c < length:
            continue
        room = c - c // length * length
        k = bisect_left(lengths, min(room + 1, length))
        while room and k > 0:
            x = lengths[k - 1]
            take = min(counts[x], room // x)
            room -= take * x
            k = min(k - 1, bisect_left(lengths, room + 1))
        content = c - room
        need = next(d for d in capacities if d >= content)
        cost = (need + overhead) / content
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def plan_packing(histogram: dict[int, int], capacities=CAPACITIES, overhead: int = SEQUENCE_COST) -> Plan:
    """Best-fit-decreasing plan for ``histogram`` (length -> number of pieces)."""
    capacities = sorted(capacities)
    counts = {k: v for k, v in histogram.items() if v > 0}
    if counts and (min(counts) < 1 or max(counts) > capacities[-1]):
        raise ValueError("lengths must lie between 1 and the largest capacity")
    lengths = sorted(counts)
    plan, opened = Plan(), 0
    open_bins: list[tuple[int, int, int, int]] = []     # (room, first bin, count, content), ascending
    for length in reversed(lengths):
        lengths_below = lengths[:bisect_left(lengths, length)]
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(open_bins, (length, -1, 0, 0))
            if k < len(open_bins):
                room, first, n, content = open_bins.pop(k)
            else:
                room = cheapest_capacity(length, capacities, counts, lengths_below, overhead)
                n, content, first = -(-left // (room // length)), 0, opened
                opened += n
            each = room // length
            full = min(n, left // each)
            for used, per in ((full, each), (1, left % each)):
                if not used or not per or n < used or not left:
                    continue
                plan.runs.append((length, rank, used * per, per, first, content))
                insort(open_bins, (room - per * length, first, used, content + per * length))
                rank, left, first, n = rank + used * per, left - used * per, first + used, n - used
            if n:
                insort(open_bins, (room, first, n, content))
    plan.bins = [(first, n, content) for _, first, n, content in open_bins]
    return plan


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 largest: int = CAPACITIES[-1]) -> DataFrame:
    """``(doc_id, piece, start, n_tokens)``: words of each text cut into pieces of ``largest``.

    A word is a run of bytes outside white space. A text without words is one piece of 0 tokens.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])

    def run(batches):
        for batch in batches:
            for block in blocks(batch, "text"):
                n = np.diff(find_words(block.column("text")).first)
                pieces = np.maximum(-(-n // largest), 1)
                doc = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * largest
                yield pa.record_batch([block.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)),
                                       pa.array(start), pa.array(np.minimum(n[doc] - start, largest).astype(np.int32))],
                                      schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, piece int, start long, n_tokens int")


def pack_pieces(pieces: DataFrame, capacities=CAPACITIES, overhead: int = SEQUENCE_COST) -> DataFrame:
    """Place each piece: adds ``seq_id``, ``seq_tokens`` (its permitted length) and ``seq_offset``.

    ``pieces`` comes from ``token_pieces``. Equal lengths are taken in the order of id and piece;
    rows that repeat both are interchangeable. Pieces without tokens get nulls; an empty table
    gives an empty result.
    """
    capacities = tuple(sorted(capacities))
    spark = pieces.sparkSession
    ordered = write_once(
        pieces.repartitionByRange(shuffle_partitions(spark), "n_tokens", "doc_id", "piece")
        .sortWithinPartitions("n_tokens", "doc_id", "piece").withColumn("part", F.spark_partition_id()), "pieces")
    held = ordered.groupBy("part", "n_tokens").agg(F.count(F.lit(1)).alias("n"))      # partitions + lengths rows
    before = held.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r["n_tokens"]: r["n"] for r in ordered.where("n_tokens > 0").groupBy("n_tokens").agg(
        F.count(F.lit(1)).alias("n")).collect()}                                      # at most max(capacities) rows
    sent = spark.sparkContext.broadcast(plan_packing(histogram, capacities, overhead).arrays())
    inside = F.row_number().over(Window.partitionBy("part", "n_tokens").orderBy("doc_id", "piece"))
    ranked = (ordered.withColumn("inside", inside).join(before, ["part", "n_tokens"])
              .select("doc_id", "piece", "start", "n_tokens", (F.col("before") + F.col("inside") - 1).alias("rank")))
    names = ["doc_id", "piece", "start", "n_tokens", "seq_id", "seq_tokens", "seq_offset"]

    def run(batches):
        runs, bins = sent.value
        key = runs[:, 0] << 44 | runs[:, 1]
        sizes = np.array(capacities)
        for batch in batches:
            n, rank = batch.column("n_tokens").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            some = n > 0
            r = runs[np.maximum(np.searchsorted(key, n << 44 | rank, side="right") - 1, 0)] if len(runs) else None
            if r is None:
                seq = size = offset = np.zeros(len(n), np.int64)
            else:
                within = rank - r[:, 1]
                per = r[:, 3]
                seq = r[:, 4] + within // per
                offset = r[:, 5] + within % per * n
                content = bins[np.searchsorted(bins[:, 0], seq, side="right") - 1, 2]
                size = sizes[np.searchsorted(sizes, content)]
            yield pa.record_batch([*batch.columns[:4], pa.array(seq, mask=~some), pa.array(size.astype(np.int32), mask=~some),
                                   pa.array(offset.astype(np.int32), mask=~some)], names)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, n_tokens int, "
                                  "seq_id long, seq_tokens int, seq_offset int")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities=CAPACITIES,
                     overhead: int = SEQUENCE_COST) -> DataFrame:
    """Pack the words of every text into sequences of the permitted lengths.

    One row per piece: ``doc_id``, ``piece``, ``start`` (first word in the text), ``n_tokens``,
    ``seq_id``, ``seq_tokens`` and ``seq_offset``. A text longer than the longest sequence is cut
    into several pieces; null and word-less texts have one piece of no tokens in no sequence; null
    and repeated ids are packed like any other; other columns are not read.
    """
    return pack_pieces(token_pieces(docs, id_col, text_col, max(capacities)), capacities, overhead)


def bpe_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
               largest: int = CAPACITIES[-1]) -> DataFrame:
    """``(row, doc_id, piece, start, n_tokens, ids)``: byte-pair tokens of each text cut into pieces of ``largest``.

    ``row`` numbers the rows of ``docs`` (write the result before it is used twice). A text without
    tokens is one piece of 0 tokens.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(content)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        model = bpe_model(spec.value)
        for batch in batches:
            for block in blocks(batch, "text"):
                rows = []
                texts = [t or "" for t in block.column("text").to_pylist()]
                for r, d, (ids, _) in zip(block.column("row").to_pylist(), block.column("doc_id").to_pylist(), model.encode_block(texts)):
                    for k, a in enumerate(range(0, max(len(ids), 1), 4 * largest)):
                        part = np.frombuffer(ids[a:a + 4 * largest], "<i4")
                        rows.append((r, d, k, a // 4, len(part), part))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "row long, doc_id long, piece int, start long, n_tokens int, ids array<int>")


def packed_sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacities=CAPACITIES,
                     overhead: int = SEQUENCE_COST) -> DataFrame:
    """The packed sequences themselves, over byte-pair tokens: one row per sequence.

    ``seq_id``, ``seq_tokens`` (its permitted length), ``n_tokens`` (its content), ``ids`` (array<int>, the content in
    order of offset) and ``parts`` (array of ``doc_id, piece, start, offset, n_tokens``: where each stretch comes from).
    A sequence holds at most the largest capacity, which bounds its row. Texts without tokens are in no
    sequence, rows that repeat an id are packed each by itself, equal lengths are taken in the order of
    the rows, and an empty table gives an empty result.
    """
    pieces = write_once(bpe_pieces(docs, tokenizer_path, id_col, text_col, max(capacities)), "bpe-pieces")
    placed = pack_pieces(pieces.where("n_tokens > 0").select(F.col("row").alias("doc_id"), "piece", "start", "n_tokens"), capacities, overhead)
    held = placed.select(F.col("doc_id").alias("row"), "piece", "seq_id", "seq_tokens", "seq_offset").join(pieces, ["row", "piece"])
    part = F.struct(F.col("seq_offset").alias("offset"), "doc_id", "piece", "start", "n_tokens", "ids")
    rows = held.groupBy("seq_id", "seq_tokens").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    n = F.aggregate("parts", F.lit(0), lambda a, p: a + p["n_tokens"])
    places = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"),
                                                     p["offset"].alias("offset"), p["n_tokens"].alias("n_tokens")))
    return rows.select("seq_id", "seq_tokens", n.alias("n_tokens"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                       places.alias("parts"))
