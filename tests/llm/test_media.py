import hashlib
import random
import zlib

import numpy as np
import pytest

from tablewise.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 5000, 100_000])
def test_round_trip(n):
    data = media.padded(random.Random(n).randbytes(n))
    assert len(data) % 64 == 0 and len(data) >= 64 and media.read_png(media.write_png(data)).tobytes() == data


def test_smooth_rows_use_filters():
    data = bytes((x + y) % 256 for y in range(40) for x in range(64))
    assert media.read_png(media.write_png(data)).tobytes() == data and len(media.write_png(data)) < 400


def test_bands(monkeypatch):
    monkeypatch.setattr(media, "BAND", 3)
    data = bytes((3 * x + 7 * y) % 256 for y in range(20) for x in range(64))
    assert media.read_png(media.write_png(data)).tobytes() == data


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_every_filter(kind):
    image = np.random.default_rng(kind).integers(0, 256, (9, 64), np.uint8)
    lines = np.zeros((9, 65), np.uint8)
    lines[:, 0] = kind
    for y in range(9):
        for x in range(64):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    head = media._chunk(b"IHDR", bytes([0, 0, 0, 64, 0, 0, 0, 9, 8, 0, 0, 0, 0]))
    data = media.SIGNATURE + head + media._chunk(b"IDAT", zlib.compress(lines.tobytes())) + media._chunk(b"IEND", b"")
    assert (media.read_png(data) == image).all()


def test_damage_is_noticed():
    good = media.write_png(bytes(640))
    for at in (3, 20, len(good) // 2, len(good) - 5):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(good[:-12])


def test_tables(spark, odd_docs):
    got = media.store_and_read(odd_docs).collect()
    assert len(got) == odd_docs.count()
    text = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in got:
        payload = media.padded(text[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    assert media.store_and_read(odd_docs.limit(0)).count() == 0
