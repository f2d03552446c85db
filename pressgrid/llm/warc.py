"""Web archives: captures to WARC 1.1 records, and transactions assembled from records that were read."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, scratch, sided

#: Payloads below this many bytes are stored each time.
REVISIT_BYTES = 1000
#: Payload bytes below which a page belongs to a class, and the records of a file of that class at most: a file
#: is read as one, so it holds about 64 MB unpacked, or one page.
FILE_CLASSES = ((1 << 16, 3000), (1 << 22, 48), (1 << 62, 3))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}/"), key))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, record_id: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    """Header lines (those with null values left out), an empty line and the block; the writer adds the record's end."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {EPOCH}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def elect_responses(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, print, refers_to`` of the pages that revisit another: of equal payloads the largest page_id is the response.

    The payload's print tells rows of one page_id with different payloads apart.
    """
    marks = pages.select("page_id", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("print")).filter(F.col("n") >= least_bytes)
    first = marks.groupBy("print").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1 and refers_to is not null")
    return marks.join(first.hint("merge"), "print").filter("page_id <> refers_to").select("page_id", "print", "refers_to").distinct()


def write_archive(pages: DataFrame, path: str, least_bytes: int = REVISIT_BYTES) -> None:
    """Writes ``pages(page_id, url, html)`` as gzipped WARC files under ``path``, by Spark's own text writer.

    Each row gives a request, a response (or a revisit of an equal payload), and a metadata record; the
    request and metadata are concurrent to the response.  A null html is an empty payload; without a URL the records have no target.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    revisits = materialize(elect_responses(rows, least_bytes)).select(F.col("page_id").alias("again"), F.col("print").alias("its_print"), "refers_to")
    rows = rows.withColumn("key", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/"), F.monotonically_increasing_id().cast("string")))
    rows = rows.join(sided(revisits), F.expr("page_id = again and sha2(payload, 256) = its_print"), "left")
    response = _urn("response", F.col("key"))
    digest = F.concat(F.lit("sha1:"), F.sha1("payload"))
    target = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    common = (("WARC-Target-URI", target),)
    request = _record("request", _urn("request", F.col("key")), F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")),
                      *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request")))
    full = _record("response", response, F.concat(head, F.col("payload")), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response")))
    again = _record("revisit", response, head, *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(PROFILE)),
                    ("WARC-Refers-To-Page", F.col("refers_to").cast("string")), ("Content-Type", F.lit("application/http;msgtype=response")))
    fields = F.concat(F.lit("page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata", F.col("key")), fields, *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields")))
    records = F.explode(F.array(request, F.when(F.col("again").isNull(), full).otherwise(again), metadata)).alias("value")
    longest, low = rows.agg(F.max(F.octet_length("payload"))).first()[0] or 0, 0
    for high, most in FILE_CLASSES:
        if low <= longest:
            part = rows.filter((F.octet_length("payload") >= low) & (F.octet_length("payload") < high)).select(records)
            part.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/below-{high}")
        low = high


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, found by Content-Length alone."""
    at, n = 0, len(data)
    while at < n:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


RECORD = "record_id string, kind string, concurrent_to string, target string, digest string, refers_to string, length bigint, fields string, payload binary"


def _gunzip(data: bytes) -> bytes:
    out, left = [], data
    while left:
        d = zlib.decompressobj(31)
        out.append(d.decompress(left))
        left = d.unused_data
    return b"".join(out)


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                rows: list[tuple] = []
                for h, block in parse_records(_gunzip(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, length, fields, payload, digest = h.get("warc-type"), None, None, None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            length, payload, digest = len(body), body if with_payload else None, hashlib.sha1(body).hexdigest()
                        else:
                            m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                            length = int(m[1]) if m else None
                    else:
                        fields = block.decode("utf-8", "replace")
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), digest, h.get("warc-refers-to-page"), length, fields, payload))
                if rows:
                    types = (pa.string(),) * 6 + (pa.int64(), pa.string(), pa.binary())
                    names = [x.split(" ")[0] for x in RECORD.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files under ``path``, gzipped or not; digest and length are taken from the payload.

    Of a revisit, digest and length are those its headers state.  ``with_payload=False`` leaves payloads out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, joined by what they are concurrent to.

    A capture without a request or metadata record has null there.  Records that are concurrent to none that exists are left out.
    """
    own = records.filter("kind in ('response', 'revisit')")
    part = {k: records.filter(F.col("kind") == k).select(F.col("concurrent_to").alias("root"), F.struct("record_id", "target", "fields").alias(k)) for k in ("request", "metadata")}
    rows = own.select(F.col("record_id").alias("root"), F.struct("record_id", "kind", "target", "digest", "refers_to", "length", "payload").alias("response"))
    for other in part.values():
        rows = rows.join(other.hint("merge"), "root", "left")
    return rows.select(F.col("root").alias("capture_id"), "request", "response", "metadata")


def archive_round_trip(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` to a new archive, reads it back and assembles it: a row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  Null html is an empty payload, null URLs
    are left out of the records, a null page_id is written but never referred to.  Of rows that repeat the
    response's page_id each is a response.  An empty table gives an empty archive and no rows.
    """
    spark = pages.sparkSession
    path = scratch(spark)
    write_archive(pages, path, least_bytes)
    captures = assemble(materialize(read_archive(spark, path, with_payload=False)))
    page = F.regexp_extract("metadata.fields", r"page: (-?\d+)", 1)
    return captures.select(
        F.when(page != "", page).cast("bigint").alias("page_id"), F.col("response.length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.col("response.refers_to").cast("bigint").alias("refers_to"),
    )
