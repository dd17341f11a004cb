"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Writing. Every page gives a request, a metadata and a response record, the first two naming the
response in WARC-Concurrent-To. Of captures with equal payloads of `REVISIT_BYTES` or more, the
one with the largest page id is a response, the others become revisit records without payload
that name it in WARC-Refers-To. Records are made by SQL functions and written by Spark's text
writer, whose line separator is the two CRLF that end a record: gzip-compressed WARC files, each
with as many captures as have `FILE_BYTES` of payload on average.

Reading. Files are read by Spark and parsed by Content-Length, header by header, so payloads may
hold anything, blank lines and WARC records too.

Assembly. Requests and metadata are joined to their response or revisit through the
concurrent-to identifiers, revisits to what they refer to, and each capture becomes one row.

Defined results: html null or empty -> empty payload, response; page_id null -> null in the
result, never the response that others revisit unless all of the group are null; rows equal in
page_id and payload are each a response; url null -> no WARC-Target-URI; empty table -> empty
archive and result; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm._shared import new_path, read_table, stored

REVISIT_BYTES = 1000
FILE_BYTES = 12_000_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a capture: page_id, url, payload, digest, bytes, record_id, kind, refers_to (record id)."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    long = rows.where(F.col("bytes") >= REVISIT_BYTES)
    # only digests that occur twice matter; added up before the shuffle
    twice = long.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(twice, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    record_id = lambda page: F.concat(F.lit("urn:capture:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"))
    return rows.select("page_id", "url", "payload", "digest", "bytes", record_id(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, record_id(F.col("first"))).alias("refers_to"))


def _record(kind, record_id, headers: list, content_type, block) -> F.Column:
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {DATE}"), *headers, F.concat(F.lit("Content-Type: "), content_type), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    # concat_ws leaves out headers that are null
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    plan = plan_records(pages)
    rows, total = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    # a target URI holds no control characters; they are percent-encoded
    url = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    uri = F.concat(F.lit("WARC-Target-URI: "), url)
    own, to = F.col("record_id"), F.concat(F.lit("WARC-Concurrent-To: <"), F.col("record_id"), F.lit(">"))
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(CRLF + CRLF))
    request = _record(F.lit("request"), F.concat(own, F.lit(":request")), [uri, to], F.lit("application/http; msgtype=request"), F.coalesce(asked, F.lit("")))
    meta = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF + "payloadBytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), F.concat(own, F.lit(":metadata")), [to], F.lit("application/warc-fields"), meta)
    refers = F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">"))
    profile = F.when(F.col("kind") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(F.col("kind") == "response", F.col("payload").cast("string")).otherwise(F.lit("")))
    main = _record(F.col("kind"), own, [uri, refers, profile, digest], F.lit("application/http; msgtype=response"), block)
    records = plan.select(F.concat_ws(CRLF + CRLF, request, metadata, main).alias("value"))
    # captures stay where the search for copies has brought them; a task opens further files as needed
    per_file = max(1, int(rows * file_bytes / max(1, total)))
    records.select("value").write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of a WARC stream, compressed or not."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield headers, block


RECORDS = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, stated_digest string, payload_digest string, payload_bytes long, page_id long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record. payload_digest and payload_bytes are computed from what was read;
    payloads=False leaves the payloads themselves out."""
    bare = lambda v: v.strip("<>") if v else None
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in RECORDS.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                plain = pa.BufferReader(raw)
                stream = gzip.GzipFile(fileobj=plain) if raw.slice(0, 2).to_pybytes() == b"\x1f\x8b" else plain
                for head, block in parse(io.BufferedReader(stream) if stream is not plain else stream):
                    kind, payload, page = head["warc-type"], None, None
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = dict(x.split(b": ", 1) for x in block.split(b"\r\n") if b": " in x)
                        page = int(fields[b"pageId"]) if fields.get(b"pageId") else None
                    digest = None if payload is None else hashlib.sha1(payload).hexdigest()
                    stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    held.append((kind, bare(head.get("warc-record-id")), bare(head.get("warc-concurrent-to")), bare(head.get("warc-refers-to")), head.get("warc-target-uri"), stated, digest, None if payload is None else len(payload), page, payload if payloads else None))
                    size += 500 + (len(block) if payloads else 0)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (response or revisit), request and metadata as structs,
    original (what a revisit refers to)."""
    # a capture's records share its identifier; duplicates of a capture are numbered apart
    main = records.where(F.col("kind").isin("response", "revisit"))
    request = records.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri").alias("request")).dropDuplicates(["record_id"])
    metadata = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "page_id").alias("metadata")).dropDuplicates(["record_id"])
    original = main.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.struct("record_id", "payload_digest", "payload_bytes", "payload").alias("original")).dropDuplicates(["refers_to"])
    nested = main.select("record_id", "refers_to", F.struct("kind", "target_uri", "stated_digest", "payload_digest", "payload_bytes", "payload").alias("capture"))
    out = nested.join(request, "record_id", "left").join(metadata, "record_id", "left")
    # responses refer to nothing and stay out of the join, so no null key gathers them
    again = out.where("refers_to IS NOT NULL").join(original, "refers_to", "left").select("record_id", "refers_to", "capture", "request", "metadata", "original")
    empty = F.lit(None).cast(original.schema["original"].dataType)
    return again.unionByName(out.where("refers_to IS NULL").withColumn("original", empty))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    records = stored(read_archives(spark, path, payloads=False), "records")
    out = assemble(records)
    full = F.coalesce(F.col("original.payload_bytes"), F.col("capture.payload_bytes"))
    digest = F.coalesce(F.col("original.payload_digest"), F.col("capture.payload_digest"))
    refers = F.regexp_extract("refers_to", "^urn:capture:(-?[0-9]+):", 1).cast("long")
    return out.select(F.col("metadata.page_id").alias("page_id"), full.alias("payload_bytes"), digest.alias("payload_digest"), F.col("capture.kind").alias("record_type"), F.when(F.col("capture.kind") == "revisit", refers).alias("refers_to"), F.col("capture.target_uri").alias("target_uri"), "record_id")
