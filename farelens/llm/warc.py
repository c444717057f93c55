"""WARC archives with revisit records and a two-level capture index.

Writing: tasks write ``.warc.gz`` files (one gzip member a record) into a shared folder under
names of their own and report each record's file, offset and length. Only what a finished task
reports is part of the archive, so a file left by a lost executor is never read.

Index: records are sorted by reversed-host URL key and id (range partitions, so a host or URL with
a third of all captures is spread over many), and each partition becomes one index file: blocks of
``BLOCK_LINES`` sorted lines, compressed, then a sparse directory with the first key and the place
of each block, then a footer. The driver keeps one row per index file.

Lookup: a key is routed to its index file, found by binary search in the directory and again in
the one block that it reads, and its record is then read by offset. Folders may be on any store
that pyarrow's file systems open by URI.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from farelens.llm.frequency import id_filter, maybe_listed
from farelens.llm.scratch import shuffle_partitions, write_once
from farelens.session import scratch_path

BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
MIN_REVISIT_BYTES = 100
_FOOTER = 24
_REPORT = "key string, id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sortable key of a URL: reversed host, then ``)`` and the path with its query.

    Scheme, user, fragment and the default ports are dropped, the host is lower-cased. A text
    that is no URL with a host keeps its place after ``)``; null counts as empty.
    """
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _sort_key(key: str, ident: int | None) -> str:
    """One text that sorts by key, then id (null first)."""
    return f"{key}\0{'' if ident is None else format(ident + 2**63, '020d')}"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _header_text(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(ident, url: str | None, payload: bytes, digest: str, size: int, date: str,
                refers_to=None, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit record (without payload) when ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if ident is None else ident}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {_header_text(url or '')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>",
                  f"WARC-Refers-To-Target-URI: {_header_text(refers_url or '')}", f"WARC-Refers-To-Date: {date}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields, and the payload of a response (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[:int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return fields


def _page_number(field: str | None) -> int | None:
    text = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_archives(captures: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``(id, url, html, digest, size, refers_to, refers_url)`` as records; one row each."""
    schema = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64())])

    def run(batches):
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                record = warc_record(r["id"], r["url"], r["html"] or b"", r["digest"], r["size"], date, r["refers_to"],
                                     r["refers_url"])
                packer = zlib.compressobj(4, wbits=31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                rows.append((url_key(r["url"]), r["id"], name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        if out is not None:
            out.close()

    wanted = captures.select("id", "url", F.col("html").cast("binary").alias("html"), "digest", "size", "refers_to", "refers_url")
    return wanted.mapInArrow(run, _REPORT)


def build_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, int, int]]:
    """Write index files; returns (first key, file, directory offset, directory length) of each."""

    def run(batches):
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out = name = first = None
        at, held, directory = 0, [], []

        def put(lines):
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], at, len(block)])
            out.write(block)
            at += len(block)

        for batch in batches:
            for key, ident, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"index-{uuid.uuid4().hex}.idx"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                held.append([_sort_key(key, ident), file, offset, length])
                first = first if first is not None else held[0][0]
                if len(held) >= block_lines:
                    put(held)
                    held = []
        if out is None:
            return
        if held:
            put(held)
        packed = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(packed)
        out.write(f"{at:012d}{len(packed):012d}".encode())
        out.close()
        yield pa.record_batch([pa.array([first]), pa.array([name]), pa.array([at]), pa.array([len(packed)])],
                              ["first", "file", "at", "length"])

    n = shuffle_partitions(records.sparkSession)
    # the id's null-first order and the zero-padded text of _sort_key agree
    rows = (records.repartitionByRange(n, F.col("key").asc(), F.col("id").asc_nulls_first())
            .sortWithinPartitions(F.col("key").asc(), F.col("id").asc_nulls_first()).select("key", "id", "file", "offset", "length"))
    parts = write_once(rows.mapInArrow(run, "first string, file string, at long, length long"), "index-parts")
    return sorted((r["first"], r["file"], r["at"], r["length"]) for r in parts.collect())    # one row per index file


class IndexReader:
    """Binary search in one index file and reads of the records that it names."""

    def __init__(self, index_folder: str, archive_folder: str, open_files: int = 32):
        self.index, self.index_root = _filesystem(index_folder)
        self.store, self.root = _filesystem(archive_folder)
        self.open_files = open_files
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.part = self.directory = self.block_at = self.block = None

    def _open(self, store, path):
        if path not in self.files:
            if len(self.files) >= self.open_files:
                self.files.popitem(last=False)[1].close()
            self.files[path] = store.open_input_file(path)
        self.files.move_to_end(path)
        return self.files[path]

    def find(self, part: tuple[str, str, int, int], sort_key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the records with this key and id."""
        if self.part != part[1]:
            f = self._open(self.index, f"{self.index_root}/{part[1]}")
            self.directory = json.loads(zlib.decompress(f.read_at(part[3], part[2])))
            self.firsts = [d[0] for d in self.directory]
            self.part, self.block_at = part[1], None
        out = []
        k = max(bisect_left(self.firsts, sort_key) - 1, 0)
        while k < len(self.directory) and self.firsts[k] <= sort_key:
            if self.block_at != k:
                _, at, length = self.directory[k]
                f = self._open(self.index, f"{self.index_root}/{part[1]}")
                lines = zlib.decompress(f.read_at(length, at)).decode().split("\n")
                self.block = [json.loads(x) for x in lines]
                self.keys, self.block_at = [x[0] for x in self.block], k
            a, b = bisect_left(self.keys, sort_key), bisect_right(self.keys, sort_key)
            out += [tuple(x[1:]) for x in self.block[a:b]]
            k += 1
        return out

    def read(self, file: str, offset: int, length: int) -> bytes:
        raw = self._open(self.store, f"{self.root}/{file}").read_at(length, offset)
        return zlib.decompress(raw, wbits=31)


def read_captures(wanted: DataFrame, parts: list[tuple[str, str, int, int]], index_folder: str,
                  archive_folder: str) -> DataFrame:
    """Records of the ``(url, id)`` rows, found through the index.

    One row per wanted row and record: ``id``, ``record_type``, ``refers_to``, ``stated_digest``,
    and of a response the ``payload_bytes`` and ``payload_digest`` of what was read. An index file
    whose range ends in equal keys is followed by the next one, so repeated rows are all found.
    """
    firsts = [p[0] for p in parts]
    schema = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("stated_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def route(batches):
        for batch in batches:
            keys = [_sort_key(url_key(u), i) for u, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            lo = [max(bisect_left(firsts, k) - 1, 0) for k in keys]
            hi = [max(bisect_right(firsts, k) - 1, 0) for k in keys]
            rows = [(p, k) for k, a, b in zip(keys, lo, hi) for p in range(a, b + 1)]
            yield pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())],
                                  ["part", "sort_key"])

    def read(batches):
        reader = IndexReader(index_folder, archive_folder)
        for batch in batches:
            rows = []
            for p, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for place in reader.find(parts[p], key):
                    f = parse_record(reader.read(*place))
                    payload = f["payload"]
                    rows.append((_page_number(f["WARC-Record-ID"]), f["WARC-Type"], _page_number(f.get("WARC-Refers-To")),
                                 f["WARC-Payload-Digest"].removeprefix("sha256:"),
                                 None if payload is None else len(payload),
                                 None if payload is None else hashlib.sha256(payload).hexdigest()))
            if rows:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    if not parts:
        return wanted.sparkSession.createDataFrame([], "id long, record_type string, refers_to long, stated_digest string, "
                                                       "payload_bytes long, payload_digest string")
    # rows equal in URL and id name the same records
    keys = wanted.select("url", "id").distinct().mapInArrow(route, "part int, sort_key string").distinct()
    return (keys.repartitionByRange(shuffle_partitions(wanted.sparkSession), "part", "sort_key")
            .sortWithinPartitions("part", "sort_key")
            .mapInArrow(read, "id long, record_type string, refers_to long, stated_digest string, "
                              "payload_bytes long, payload_digest string"))


def find_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``(id, refers_to, refers_url)`` of records that repeat the payload of a smaller id."""
    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.col(html_col).cast("binary"), 256).alias("digest"),
                          F.octet_length(html_col).alias("size"), F.col(url_col).cast("string").alias("url")).where(
        F.col("id").isNotNull() & (F.col("size") >= min_bytes))
    narrow = write_once(narrow.select("id", "digest", "url"), "payload-digests")
    heads = narrow.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("head"), F.max("id").alias("last")).where("last > head.id")
    return (narrow.join(heads, "digest").where("id > head.id")
            .select("id", F.col("head.id").alias("refers_to"), F.col("head.url").alias("refers_url"), "digest"))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every page as a WARC record, index the archives, and read all captures back.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a
    response and the others revisit it; smaller ones are all responses. Returns per page ``id``,
    ``payload_bytes``, ``payload_digest`` (of the payload as read back, through the response that a
    revisit names), ``record_type`` and ``refers_to``.

    Defined cases: a null payload is empty; a null URL is an empty one; a page with a null id is a
    response; rows that share an id are records of their own, with equal payloads all of one type;
    an empty table writes nothing and gives an empty result; other columns are not read. Pages that
    are no revisits are written where they are read; only the revisits are shuffled.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    revisits = write_once(find_revisits(pages, id_col, url_col, html_col, min_bytes), "revisits")
    table = id_filter(revisits.select("id"))
    raw = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), raw.alias("html"))
    sized = [F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size")]
    listed = maybe_listed(base, "id", table).select("*", *sized)
    named = revisits.select("id", "digest", "refers_to", "refers_url").distinct()
    again = listed.join(named, ["id", "digest"], "left").select(
        "id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to", "refers_url")
    once = maybe_listed(base, "id", table, keep=False).select(
        "*", *sized, F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    records = write_once(write_archives(once.unionByName(again), f"{folder}/archives"), "warc-records")
    parts = build_index(records, f"{folder}/index")
    read = write_once(read_captures(pages.select(F.col(url_col).cast("string").alias("url"), F.col(id_col).cast("long").alias("id")),
                                    parts, f"{folder}/index", f"{folder}/archives"), "read-back")
    full = (read.where("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"),
                                                         "payload_bytes").distinct())
    back = read.where("record_type = 'revisit'").select("id", "record_type", "refers_to", "stated_digest").join(
        full, ["refers_to", "stated_digest"], "left")
    return (read.where("record_type = 'response'").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
            .unionByName(back.select("id", "payload_bytes", F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to")))
