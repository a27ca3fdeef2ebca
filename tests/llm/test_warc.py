import gzip
import hashlib

import pytest

from tablewise.llm import warc

ROWS = [(1, "http://a", "x" * 1500), (2, None, "x" * 1500), (3, "u\r\nz", "x" * 1500), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "x" * 1500), (8, "é", "é\r\n\r\nWARC/1.1\r\n" * 200), (9, "e", "é\r\n\r\nWARC/1.1\r\n" * 200), (3, "u", "x" * 1500), (10, "v", "y" * 999), (11, "v", "y" * 999)]


def test_revisits(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS refers_to")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        keeper = max((p for p, _, h in ROWS if h == html and p is not None), default=None) if len(body) >= 1000 else i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if keeper == i else "revisit", None if keeper == i else keeper))
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archives_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    read = {r.page_id: r for r in warc.read_archives(spark, path, payloads=True).collect() if r.record_type == "response"}
    assert bytes(read[9].payload).decode() == ROWS[9][2] and read[9].url == "e" and read[3].url in ("uz", "u")


def test_damage_is_noticed():
    record = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nA\r\n\r\nbody\r\n\r\n"
    assert [p for _, p in warc.split_records(record)] == [b"body"]
    for bad in (record[:-1], b"x" + record, record.replace(b"9", b"8")):
        with pytest.raises(ValueError):
            list(warc.split_records(bad))
    assert warc.unpacked(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and warc.unpacked(record) == record
