import gzip
import hashlib
import io

from tabloom.llm import warc as W
from tabloom.llm._shared import new_path

BIG = "x" * 2000
ROWS = [(1, "http://a/1", BIG, "k"), (5, "http://a/5", BIG, "k"), (3, None, BIG, "k"), (2, "http://b/", "small", "k"), (4, "http://b/", "small", "k"), (6, "http://c/é ?q", None, "k"), (7, "u", "", "k"), (8, "http://d", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nü" * 60, "k"), (None, "http://e", "nobody", None), (9, "bad\r\nX: y", "z" * 1500, "k"), (9, "bad\r\nX: y", "z" * 1500, "k")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string")


def test_round_trip(spark, tmp_path):
    path = new_path(spark, "warc")
    W.write_archives(pages(spark, ROWS), path, file_bytes=3000)
    out = W.assemble(W.read_archives(spark, path)).collect()
    assert len(out) >= len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r["metadata"]["page_id"], r)
    for page, url, html, _ in ROWS:
        r, raw = by[page], (html or "").encode()
        kept = r["original"] or r["capture"]
        assert kept["payload"] == raw and kept["payload_digest"] == hashlib.sha1(raw).hexdigest() == r["capture"]["stated_digest"]
        assert (r["capture"]["kind"] == "revisit") == (page in (1, 3))
        assert r["request"]["record_id"].endswith(":request")
    assert by[1]["refers_to"] == by[5]["record_id"]


def test_repeated_pages_count_each(spark):
    path = new_path(spark, "warc")
    W.write_archives(pages(spark, ROWS), path)
    assert W.assemble(W.read_archives(spark, path, payloads=False)).count() == len(ROWS)


def test_files_are_warc(spark):
    path = new_path(spark, "warc")
    W.write_archives(pages(spark, ROWS[:2]), path)
    raw = b"".join(gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").load(path).collect())
    kinds = [h["warc-type"] for h, _ in W.parse(io.BytesIO(raw))]
    assert sorted(kinds) == ["metadata", "metadata", "request", "request", "response", "revisit"] and raw.endswith(b"\r\n\r\n")


def test_empty(spark):
    path = new_path(spark, "warc")
    W.write_archives(pages(spark, []), path)
    assert W.assemble(W.read_archives(spark, path)).count() == 0
