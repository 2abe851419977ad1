"""WARC archives with revisit records: write deduplicated archives, read them back, resolve the revisits.

Headers (page id, digest and length of payloads that can be revisited) are shuffled by digest; of each digest that
repeats, the response's page id is joined to the pages while they are written. As long as these few rows have a small
size, which is checked, the payloads themselves are not shuffled.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table

CRLF = "\r\n"
#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 1000
#: Records of an archive: at most so many, and of at most about so many bytes at their mean size.
RECORDS_PER_FILE, BYTES_PER_FILE = 2000, 64_000_000
#: Repeated digests are sent to all tasks up to this size, and joined by a shuffle of the pages beyond.
BROADCAST_BYTES, BYTES_PER_DIGEST = 32_000_000, 80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_READ = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def _page_uri(col):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(col.cast("string"), F.lit("null")), F.lit(">"))


def repeated_payloads(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """digest, original: of payloads of ``min_bytes`` and more that occur more than once, the largest page id."""
    h = pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    return h.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1 AND original IS NOT NULL").drop("copies")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Write one WARC/1.1 record per row of (page_id, url, html) as gzip text files of whole records.

    Every record has an id of its own, but for responses that others refer to: theirs is made of the page id. A record ends
    in CR LF CR LF, which is the files' line separator. Payloads too small for a revisit take no part in the join.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    originals = scratch.save(repeated_payloads(pages, min_bytes), "originals")
    size = pages.agg(F.count("*"), F.sum(F.octet_length("html").cast("long"))).first()
    per_file = max(1, min(RECORDS_PER_FILE, BYTES_PER_FILE * (size[0] or 1) // max(1, size[1] or 1)))
    if originals.count() * BYTES_PER_DIGEST <= broadcast_bytes:
        originals = F.broadcast(originals)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload").cast("long"))
    p = p.join(originals.withColumnRenamed("digest", "of"), F.when(F.col("n") >= min_bytes, F.col("digest")) == F.col("of"), "left")
    answers = F.col("page_id").eqNullSafe(F.col("original"))
    revisit = F.col("original").isNotNull() & ~answers
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace("url", r"[\r\n]", "%0A")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(answers, _page_uri(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _page_uri(F.col("original"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block,
    )
    p.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    scratch.drop("originals")


def _head(stream) -> list[bytes]:
    """Lines up to the next empty one; none at the end of the archive."""
    lines = []
    while line := stream.readline():
        if line == b"\r\n":
            break
        lines.append(line.rstrip(b"\r\n"))
    return lines


def parse_records(stream) -> Iterator[tuple]:
    """Rows of the read schema for every record of one archive, a record at a time; lengths come from the headers, never from
    the payload."""
    page = lambda v: None if v is None else int(v.removeprefix(b"<urn:x-page:").removesuffix(b">"))
    while lines := _head(stream):
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        block = stream.read(int(fields[b"Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields[b'WARC-Record-ID']!r} doesn't end where its length says")
        body = block.index(b"\r\n\r\n") + 4
        kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        full = kind == "response"
        uri = fields.get(b"WARC-Target-URI")
        yield (
            page(fields.get(b"X-Page-ID")), uri and uri.decode("utf-8", "replace"), kind, len(block) - body if full else None, digest,
            page(fields.get(b"WARC-Refers-To")), hashlib.sha1(memoryview(block)[body:]).hexdigest() == digest if full else None,
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``; ``intact`` says whether a response's payload has the digest of its header."""
    names = [f.split()[0] for f in _READ.split(", ")]

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                # The archive is unpacked as it is read: only its packed bytes and one record are held.
                rows = list(parse_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, _READ)


def resolve(records: DataFrame) -> DataFrame:
    """Give every revisit the size of the response that it refers to (same page id and digest)."""
    r = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    sizes = r.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    return r.unionByName(revisits.join(sizes, ["refers_to", "payload_digest"], "left"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back and resolve them: page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri, intact.

    A null html is an empty payload. Of equal payloads of 1000 bytes or more the largest page_id is the response (every
    row of it, if that id repeats; all rows, if no row has an id); rows without an id can be revisits. Null URLs have no
    target. Other columns are not read; an empty table gives an empty result. Rows that repeat a page id and a payload repeat
    a record's id if others refer to it.
    """
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write_archives(pages, path)
    out = resolve(read_archives(spark, path))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "intact")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM q
"""
