"""Ids that repeat with other texts, and null ids: a row each, by its own text."""

import hashlib

from tablewise.llm import bpe, media, warc
from tablewise.llm.registry import TOKENIZER

ROWS = [(1, "one text here"), (1, "another text there"), (1, "another text there"), (None, "no id"), (None, "no id, again"), (1, None)]


def frame(spark, names="doc_id bigint, text string"):
    return spark.createDataFrame(ROWS, names)


def padded(text):
    data = (text or "").encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def test_media(spark):
    got = sorted(((r.doc_id, r.payload_sha256) for r in media.store_and_read(frame(spark)).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256(padded(t)).hexdigest()) for i, t in ROWS), key=str)


def test_bpe(spark):
    got = sorted(((r.doc_id, r.decoded_sha256) for r in bpe.round_trip(frame(spark), TOKENIZER).collect()), key=str)
    alone = {t: bpe.round_trip(spark.createDataFrame([(0, t)], "doc_id bigint, text string"), TOKENIZER).first().decoded_sha256 for t in {t for _, t in ROWS}}
    assert got == sorted(((i, alone[t]) for i, t in ROWS), key=str)


def test_warc(spark):
    pages = spark.createDataFrame([(i, "http://x", t and t * 200) for i, t in ROWS], "page_id bigint, url string, html string")
    got = sorted(((r.page_id, r.payload_digest) for r in warc.archive_and_read(pages).collect()), key=str)
    assert got == sorted(((i, hashlib.sha1(((t or "") * 200).encode()).hexdigest()) for i, t in ROWS), key=str)
