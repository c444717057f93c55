"""Removal of repeated runs of lines by winnowing.

The lines of a document (blank ones skipped, outer white space ignored) are a sequence of 64-bit
hashes. Of every ``min_lines`` consecutive lines the one with the smallest hash is selected as a
fingerprint, so a run that two documents share selects the same line in both. The selected
lines are counted first, in a sketch of fixed size; only fingerprints that may occur twice are
posted, with their position and the lines beside them. Postings with equal fingerprints are joined
by position: a match is extended from the fingerprint to the left and to the right over the
neighbouring line hashes as far as the window that selected it reaches, and of matches that agree the
earliest place stays while every later run is deleted. Matches of neighbouring fingerprints overlap, so
longer runs are covered whatever their length. A line of ``min_bytes`` or more is a window by
itself, so a long line is found without its neighbours.

Scale: within a map task only the earliest posting of a match travels; its later ones are
known repeats at once. A boilerplate run in a third of all documents therefore costs one row per
map task and no pairs. A fingerprint that a third of all documents share beside ever new neighbours is
spread: postings travel by fingerprint and neighbours. Deletions are gathered per document and
joined to the texts once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from farelens.llm.frequency import SKETCH_SCHEMA, CountSketch, id_filter, maybe_listed, maybe_listed_ids, sum_sketch
from farelens.llm.scratch import bound_batches, shuffle_partitions, write_once
from farelens.llm.words import _SPACE, blocks, mix, replace_text, run_hashes, span_hashes, text_buffer, with_text

FLUSH_WINDOWS = 250_000
SKETCH_BITS = 22       # counters of fingerprints; shared ones post more than needed and change no result
_ALONE = np.uint64(0xA24BAED4963EE407)    # keeps lone lines apart from runs
_PLACES = pa.schema([("match", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("run", pa.int32()),
                     ("repeat", pa.bool_())])


class Lines:
    """Lines of a block of texts: spans without outer white space, and which are blank."""

    def __init__(self, texts: pa.Array):
        self.data, off = text_buffer(texts, b"\n")
        self.ends = np.flatnonzero(self.data == 0x0A)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.first = np.searchsorted(self.ends, off)
        ink = np.flatnonzero(~_SPACE[self.data])
        a, b = np.searchsorted(ink, self.starts), np.searchsorted(ink, self.ends)
        self.filled = np.flatnonzero(b > a)
        self.filled_first = np.searchsorted(self.filled, self.first)
        lo, hi = ink[a[self.filled]], ink[b[self.filled] - 1] + 1
        self.sizes = hi - lo
        self.hashes = span_hashes(self.data, lo, hi) if len(self.filled) else np.zeros(0, np.uint64)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash in each run of ``width`` hashes (the last of equal ones)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, width):
        lower = hashes[j:j + n] <= best
        best = np.where(lower, hashes[j:j + n], best)
        at = np.where(lower, np.arange(j, j + n), at)
    return at


def _selected(lines: Lines, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, selected line, document) of every window of ``width`` lines inside a document."""
    selected = winnow(lines.hashes, width)
    first = np.arange(len(selected))
    doc = np.searchsorted(lines.filled_first, first, side="right") - 1
    inside = first + width <= lines.filled_first[doc + 1]
    return first[inside], selected[inside], doc[inside]


def _fingerprints(lines: Lines, width: int, min_bytes: int | None) -> np.ndarray:
    """Hashes of the selected lines of a block, each line once, and of the lines that are windows by themselves."""
    chosen = np.zeros(len(lines.hashes), bool)
    chosen[_selected(lines, width)[1]] = True
    if min_bytes is not None:
        chosen |= lines.sizes >= min_bytes
    return lines.hashes[chosen]


def repeated_fingerprints(texts: DataFrame, width: int, min_bytes: int | None) -> np.ndarray:
    """Slots of fingerprints that may occur more than once in the table (``2 ** SKETCH_BITS`` flags)."""
    def count(batches):
        sketch = CountSketch(SKETCH_BITS)
        for batch in batches:
            for block in blocks(batch, "text"):
                sketch.add(_fingerprints(Lines(block.column("text")), width, min_bytes))
        for i, packed in sketch.packed():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])

    return sum_sketch(texts.mapInArrow(count, SKETCH_SCHEMA), SKETCH_BITS) > 1


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _postings(lines: Lines, width: int, min_bytes: int | None, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match, document, run) of each window whose fingerprint is listed.

    The match is the fingerprint extended to both sides: its hash with the hashes of the lines before
    and after it in the window, and how many lie on each side. ``run`` is twice the first line,
    plus one for a line that is a window by itself.
    """
    h = lines.hashes
    first, at, doc = _selected(lines, width)
    posted = listed[_slot(h[at])]
    first, at, doc = first[posted], at[posted], doc[posted]
    left, right = at - first, first + width - 1 - at
    match = h[at].copy()
    for j in range(1, width):
        before, after = j <= left, j <= right
        match[before] = mix(match[before] ^ mix(h[at[before] - j] + np.uint64(2 * j)))
        match[after] = mix(match[after] ^ mix(h[at[after] + j] + np.uint64(2 * j + 1)))
    run = 2 * (first - lines.filled_first[doc])
    if min_bytes is None:
        return match, doc, run
    alone = np.flatnonzero((lines.sizes >= min_bytes) & listed[_slot(h)])
    of = np.searchsorted(lines.filled_first, alone, side="right") - 1
    return (np.concatenate([match, mix(h[alone] ^ _ALONE)]), np.concatenate([doc, of]),
            np.concatenate([run, 2 * (alone - lines.filled_first[of]) + 1]))


def _places(docs: DataFrame, width: int, min_bytes: int | None) -> DataFrame:
    """Earliest place of each match per task, and later places in the task as repeats."""
    sent = docs.sparkSession.sparkContext.broadcast(repeated_fingerprints(docs.select("text"), width, min_bytes))

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            match, doc, fp, first = np.concatenate(held, axis=1)
            held.clear()
            order = np.lexsort((first, fp, doc, match))
            match, doc, fp, first = match[order], doc[order], fp[order], first[order]
            lead = np.concatenate([[True], match[1:] != match[:-1]])
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            moved = (doc != doc[head]) | (fp != fp[head]) | (first != first[head])
            keep = lead | moved
            return pa.record_batch([pa.array(x[keep]) for x in (match, doc, fp, first.astype(np.int32), moved)], schema=_PLACES)

        n = 0
        for batch in batches:
            for block in blocks(batch, "text"):
                match, doc, first = _postings(Lines(block.column("text")), width, min_bytes, sent.value)
                held.append(np.stack([match.view(np.int64), block.column("doc_id").to_numpy()[doc],
                                      block.column("fp").to_numpy()[doc], first]))
                n += len(match)
                if n >= FLUSH_WINDOWS:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return docs.mapInArrow(run, "match long, doc_id long, fp long, run int, repeat boolean")


def _later(places: DataFrame) -> DataFrame:
    """Places that are not the earliest of their match over all tasks."""

    def run(batches):
        last = None          # (match, doc, fp, run) of the earliest place of the current match
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if last is not None:
                cols = [np.concatenate([[v], c]).astype(c.dtype) for v, c in zip(last, cols)]
            match = cols[0]
            lead = np.concatenate([[True], match[1:] != match[:-1]])
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            moved = (cols[1] != cols[1][head]) | (cols[2] != cols[2][head]) | (cols[3] != cols[3][head])
            yield pa.record_batch([pa.array(c[moved]) for c in cols[1:]], ["doc_id", "fp", "run"])
            last = [c[head[-1]] for c in cols]

    n = shuffle_partitions(places.sparkSession)
    return (places.repartition(n, "match").sortWithinPartitions("match", "doc_id", "fp", "run")
            .mapInArrow(run, "doc_id long, fp long, run int"))


def _rewrite(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_bytes: int | None,
             report: bool) -> DataFrame:
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    if min_bytes is not None and min_bytes < 1:
        raise ValueError("min_bytes must be positive")
    row = F.struct(F.col(text_col).alias("text")) if report else F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    at_text = 0 if report else docs.columns.index(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("fp"),
                       F.col(text_col).alias("text"), row.alias("row"))
    judged = base.where("doc_id is not null and text is not null").select("doc_id", "fp", "text")
    bound_batches(docs.sparkSession)
    places = write_once(_places(judged, min_lines, min_bytes), "line-postings")
    known = places.where("repeat").select("doc_id", "fp", "run")
    found = known.unionAll(_later(places.where("not repeat").select("match", "doc_id", "fp", "run")))
    per_doc = write_once(found.groupBy("doc_id", "fp").agg(F.collect_list("run").alias("runs")), "repeated-lines")
    # only documents that may be listed are shuffled to meet their repeats; the others are done at once. The hint keeps
    # a shuffle between the two Python steps: in one task they would hold two workers
    table = id_filter(per_doc.select("doc_id"))
    rows = base.select("doc_id", "fp", "row")
    listed = maybe_listed(rows, "doc_id", table).join(per_doc.hint("merge"), ["doc_id", "fp"], "left").select("doc_id", "runs", "row")
    others = rows.select("doc_id", F.lit(None).cast("array<int>").alias("runs"), "row")
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def apply_others(batches):
        return apply(b.filter(pc.invert(maybe_listed_ids(sent.value, b.column(0)))) for b in batches)

    def apply(batches):
        for batch in batches:
            for block in blocks(with_text(batch, 2, at_text), "text"):
                lines = Lines(block.column("text"))
                n = np.diff(lines.first)
                step = np.zeros(len(lines.filled) + 1, np.int64)
                lists = block.column("runs")
                doc = np.repeat(np.arange(block.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                runs = lists.flatten().to_numpy()
                at = (runs >> 1) + lines.filled_first[doc]
                np.add.at(step, at, 1)
                np.add.at(step, at + np.where(runs & 1, 1, min_lines), -1)
                removed = np.zeros(len(lines.ends), bool)
                removed[lines.filled[np.cumsum(step[:-1]) > 0]] = True
                gone = np.add.reduceat(np.append(removed, False).astype(np.int64), lines.first[:-1])
                length = lines.ends - lines.starts + 1
                kept = lines.data[np.repeat(~removed, length)].tobytes()
                edge = np.concatenate([[0], np.cumsum(np.where(removed, 0, length))])[lines.first].tolist()
                texts = [kept[a:max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:])]
                if report:
                    size = pc.fill_null(pc.binary_length(block.column("text")), 0).to_numpy(zero_copy_only=False)
                    yield pa.record_batch([block.column("doc_id"), pa.array(np.where(size > 0, n, 0)), pa.array(gone),
                                           pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                                          ["doc_id", "n_lines", "n_removed", "kept_sha256"])
                else:
                    yield pa.record_batch([replace_text(block.column("row"), at_text, gone > 0, texts)], ["row"])

    if report:
        schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string"
        return listed.mapInArrow(apply, schema).unionByName(others.mapInArrow(apply_others, schema))
    schema = T.StructType([T.StructField("row", base.schema["row"].dataType)])
    return listed.mapInArrow(apply, schema).unionByName(others.mapInArrow(apply_others, schema)).select("row.*")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
               min_bytes: int | None = None) -> DataFrame:
    """``docs`` without the lines covered by a run of ``min_lines`` lines that also starts earlier.

    With ``min_bytes``, a line of at least so many bytes (UTF-8, without outer white space) is a run
    by itself whatever stands beside it; shorter lines still need neighbours.

    Earlier means a smaller id, or the same document and an earlier line; runs are judged on the
    input, on lines without their outer white space, and skip blank lines, which are kept. A text
    that loses lines holds the others joined by line feeds; rows and other columns stay. Lines are
    compared by 64-bit hashes, matches by a hash over those of their lines.

    Defined cases: a null or empty text has no lines and stays; a row with a null id is kept whole;
    rows equal in id and text count as one document; rows that share an id but not the text are
    ordered by a hash of the text; an empty table gives an empty result; other columns may have any
    name.
    """
    return _rewrite(docs, id_col, text_col, min_lines, min_bytes, report=False)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
                min_bytes: int | None = None) -> DataFrame:
    """What ``line_dedup`` keeps, per row: ``doc_id``, ``n_lines``, ``n_removed`` and
    ``kept_sha256`` (of the kept lines joined by line feeds, in UTF-8)."""
    return _rewrite(docs, id_col, text_col, min_lines, min_bytes, report=True)
