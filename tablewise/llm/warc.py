"""WARC archives: revisit resolution, deduplicated writing and reading back.

Headers (id, digest, size) of all pages are shuffled by payload digest, each group of equal payloads
keeps its largest id as the response, and the others become revisit records that refer to it. Bodies
are never grouped; they meet their header's decision by page id and go straight to the archive.

A WARC record ends with an empty line, that is CR LF CR LF, so Spark's text writer with that line
separator writes WARC files, gzipped: tasks commit like any other Spark output, and the archives may
lie in any store that Spark can write to. Files are read back whole, split by Content-Length and
every response's SHA-1 is computed anew and held against its header.

Defined results: null html is an empty payload; payloads under ``MIN_BYTES`` are all responses;
rows with the same page id and payload are the same kind; null page ids are written without a
number and read back as null; a record whose digest or length is wrong raises ``ValueError``;
further input columns are ignored; no pages give no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import map_batches, meet, scratch, stored

#: Payloads smaller than this are never revisits.
MIN_BYTES = 1_000
#: About how large archive files become, and the most records that one holds.
FILE_BYTES, FILE_RECORDS = 32 << 20, 100_000
CRLF, END = "\r\n", "\r\n\r\n"
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URI = "urn:page:"
GZIP = b"\x1f\x8b"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + END


def resolve(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, digest, size, refers_to) of the pages that repeat another page's payload."""
    body = F.coalesce(pages[html], F.lit("")).cast("binary")
    heads = pages.select(pages[key].alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    first = heads.where(F.col("size") >= MIN_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    found = meet(heads, stored(first.select("digest", "n", "refers_to")), "digest", "n", "refers_to")
    return found.where("refers_to is not null and not (page_id <=> refers_to)").distinct()


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, html: str = "html", key: str = "page_id", url: str = "url", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per page: a response with its payload, or a revisit without."""
    body = F.coalesce(pages[html], F.lit(""))
    all_pages = pages.select(pages[key].alias("page_id"), F.regexp_replace(F.coalesce(pages[url].cast("string"), F.lit("")), r"\s", "").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    repeats = resolve(pages, html, key).select(F.col("page_id").alias("id"), F.col("digest").alias("its"), "refers_to")
    rows = all_pages.join(repeats, all_pages["page_id"].eqNullSafe(F.col("id")) & (F.col("digest") == F.col("its")), "left")
    revisit = F.col("refers_to").isNotNull()
    uri = lambda c: F.concat(F.lit(f"<{RECORD_URI}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", uri(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.when(F.col("url") != "", _line("WARC-Target-URI", F.col("url"))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", uri(F.col("refers_to"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(payload) + len(HTTP_HEAD)).cast("string")),
        F.lit(CRLF + HTTP_HEAD),
        payload,
    )
    mean = pages.select(F.avg(F.octet_length(pages[html]))).first()[0] or 0
    most = max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 600))))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", "gzip").mode("overwrite").text(path)


def unpacked(data: bytes) -> bytes:
    """The bytes of a file, out of gzip if it is a gzip file of one or more members."""
    return gzip.decompress(data) if data[:2] == GZIP else data


def split_records(data: bytes):
    """(headers, payload) of each record of a WARC file."""
    at = 0
    while at < len(data):
        stop = data.find(END.encode(), at)
        lines = data[at:stop].decode("utf-8", "surrogateescape").split(CRLF)
        if stop < 0 or not re.fullmatch(r"WARC/1\.\d", lines[0]):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin = stop + len(END)
        end = begin + int(headers["content-length"])
        if data[end : end + len(END)] != END.encode():
            raise ValueError(f"record at byte {at} has the wrong length")
        payload = data.find(END.encode(), begin, end) + len(END)
        yield headers, data[payload:end]
        at = end + len(END)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if
    asked for, payload. Size and payload of a revisit are null until ``with_originals``."""

    def number(uri: str | None) -> int | None:
        found = (uri or "").strip("<>").removeprefix(RECORD_URI)
        return int(found) if found else None

    def run(batches):
        for b in batches:
            for cell in b.column(0):
                rows = []
                for h, payload in split_records(unpacked(cell.as_py())):
                    digest, response = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "response"
                    if response and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                    rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), digest, len(payload) if response else None, payload if response and payloads else None))
                    if len(rows) >= 1_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    names = schema.names
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    found = map_batches(files, run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")
    return found if payloads else found.drop("payload")


def with_originals(records: DataFrame) -> DataFrame:
    """Fill in each revisit's size from the response that it refers to."""
    ref = lambda c: F.concat_ws(":", c, "payload_digest")
    originals = records.where("record_type = 'response'").where(F.col("payload_bytes") >= MIN_BYTES).select(ref(F.col("page_id").cast("string")).alias("ref"), F.col("payload_bytes").alias("its_bytes")).distinct()
    revisits = records.withColumn("ref", F.when(F.col("refers_to").isNotNull(), ref(F.col("refers_to").cast("string"))))
    counts = revisits.where("ref is not null").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    joined = meet(revisits, stored(counts.join(originals, "ref")), "ref", "n", "its_bytes")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "its_bytes")).drop("ref", "its_bytes")


def archive_and_read(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Write deduplicated archives to the shared folder, read them back and describe every page."""
    spark = pages.sparkSession
    path = scratch(spark)
    write_archives(pages, path, html, key, url)
    found = with_originals(stored(read_archives(spark, path)))
    return found.select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
