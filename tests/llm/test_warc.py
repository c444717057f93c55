"""WARC round trip, index lookups and awkward pages."""
import gzip
import hashlib
import os
from collections import Counter

from pyspark.sql import functions as F

from farelens.llm import warc
from farelens.llm.scratch import write_once
from farelens.llm.warc import IndexReader, build_index, find_revisits, parse_record, url_key, warc_round_trip, write_archives

SCHEMA = "page_id long, url string, html string, digest string, size int, key string, record_type string"


def _pages():
    big, other = "<p>" + "x" * 200, "é" * 60
    rows = [(i, f"https://Host{i % 7}.Example.com:443/p{i % 5}?q={i}#f", f"<html>{i}</html>" * (i % 40)) for i in range(200)]
    rows += [(300 + i, "http://hot.example/", big) for i in range(80)]
    rows += [(400, None, None), (401, "", ""), (402, "not a url\r\nX: y", other), (403, "http://[bad", other), (None, "http://n/", big),
             (404, "http://s/", "short"), (405, "http://s/", "short"), (406, "http://t/", big + "\r\n\r\nWARC/1.1\r\n"),
             (300, "http://hot.example/", big), (407, "http://u/", big), (407, "http://u/", "another text of a page" * 9)]
    return [(*r, "d", 1, "k", "t") for r in rows]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = _pages()
    heads = {}
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            heads[raw] = min(heads.get(raw, i), i)
    want = Counter()
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= 100 and heads[raw] < i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", heads[raw] if again else None] += 1
    out = warc_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.columns == ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, out.collect())) == want


def test_empty(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    assert find_revisits(spark.createDataFrame([], SCHEMA), "page_id", "url", "html", 100).collect() == []


def test_index_blocks_and_files(spark, tmp_path):
    n = 500
    df = spark.range(n).select("id", F.concat(F.lit("http://a.b/"), F.col("id") % 50).alias("url"), F.lit("<p>").alias("html"),
                               F.lit("0").alias("digest"), F.lit(3).alias("size"), F.lit(None).cast("long").alias("refers_to"),
                               F.lit(None).cast("string").alias("refers_url"))
    records = write_once(write_archives(df, f"{tmp_path}/w", file_bytes=5000), "records")
    assert len(os.listdir(tmp_path / "w")) > 5
    parts = build_index(records, f"{tmp_path}/i", block_lines=16)
    reader = IndexReader(f"{tmp_path}/i", f"{tmp_path}/w", open_files=2)
    firsts = [p[0] for p in parts]
    for i in (0, 17, 49, 50, 333, 499):
        key = warc._sort_key(url_key(f"http://a.b/{i % 50}"), i)
        part = parts[max(warc.bisect_right(firsts, key) - 1, 0)]
        (place,) = reader.find(part, key)
        record = parse_record(reader.read(*place))
        assert record["WARC-Record-ID"] == f"<urn:page:{i}>" and record["payload"] == b"<p>"
        assert reader.find(part, key + "0") == []
    # each record is a gzip member of its own
    name = sorted(os.listdir(tmp_path / "w"))[0]
    assert gzip.open(tmp_path / "w" / name).read().startswith(b"WARC/1.1\r\n")


def test_url_keys():
    assert url_key("https://User@Blog.Example.com:443/a/B?x=1#y") == "com,example,blog)/a/B?x=1"
    assert url_key("http://e.com:8080") == "com,e:8080)/"
    assert url_key(None) == ")" and url_key("no url") == ")no url"
