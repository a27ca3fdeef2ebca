"""Media columns: lossless PNG images in binary columns, and what is computed from them.

``write_png`` stores a payload as an 8-bit grey image 64 samples wide, one filter byte a row, in a
PNG built chunk by chunk; ``read_png`` checks every chunk's CRC-32 and zlib's own checksum, undoes
the row filters with numpy and gives the samples back. ``cosine_hash`` keeps the signs of the
low-frequency terms of a discrete cosine transform of the image, shrunk by area.

Defined results: null and empty texts are a payload of 64 zero bytes; the width of 64 makes every
payload whole rows; texts of any length are stored whole, one image a text; equal texts have equal
rows; null and repeated ids stay, a row each; a damaged image raises ``ValueError``; further
input columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewise.llm.common import map_batches, stored

WIDTH = 64
#: zlib's effort; the fastest keeps most of the gain on text.
LEVEL = 1
#: Side of the shrunken image, and of the block of low frequencies that is kept.
SHRUNK, KEPT = 32, 8
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Rows of a band that is filtered or unfiltered at once.
BAND = 16_384


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload with bytes 0 up to a positive multiple of the width."""
    return payload + bytes(max(width, -(-len(payload) // width) * width) - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of the samples, row by row.

    A row takes the filter (none, left, up) whose residues, read as signed, are smallest in sum.
    """
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    packer, out = zlib.compressobj(LEVEL), []
    above = np.zeros((1, width), np.uint8)
    for at in range(0, len(image), BAND):
        rows = image[at : at + BAND]
        left = rows.copy()
        left[:, 1:] -= rows[:, :-1]
        up = rows - np.concatenate([above, rows[:-1]])
        above = rows[-1:]
        cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, left, up)])
        kind = cost.argmin(0)
        lines = np.empty((len(rows), width + 1), np.uint8)
        lines[:, 0] = kind
        lines[:, 1:] = np.choose(kind[:, None], (rows, left, up))
        out.append(packer.compress(lines.tobytes()))
    out.append(packer.flush())
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(out)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows; runs of rows with one filter are undone together."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *edges], [*edges, len(kinds)]):
        kind = kinds[start]
        if kind == 1:
            np.add.accumulate(out[start:end], axis=1, out=out[start:end])
        elif kind == 2:
            first = max(start - 1, 0)
            np.add.accumulate(out[first:end], axis=0, out=out[first:end])
        elif kind in (3, 4):
            for y in range(start, end):
                _unfilter_row(out, y, kind)
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
    return out


def _unfilter_row(out: np.ndarray, y: int, kind: int) -> None:
    """Average and Paeth rows, where every sample needs the one before it."""
    row, up, a, c = out[y], out[y - 1].tolist() if y else [0] * out.shape[1], 0, 0
    for x, residue in enumerate(row.tolist()):
        b = up[x]
        if kind == 3:
            guess = (a + b) // 2
        else:
            near = a + b - c
            guess = min(((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c)))[2]
        a, c = (residue + guess) & 255, b
        row[x] = a


def read_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey PNG without interlace."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("incomplete, or not an 8-bit grey image")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    return _unfilter(lines.reshape(height, width + 1))


@cache
def _cosines(n: int, kept: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(kept), np.arange(n) + 0.5)).astype(np.float32)


def _shrink(image: np.ndarray, size: int) -> np.ndarray:
    """Means over a size x size grid; an image with fewer rows repeats them."""
    h, w = image.shape
    if h < size:
        image = np.repeat(image, -(-size // h), axis=0)
        h = len(image)
    columns = image.reshape(h, size, w // size).sum(2, dtype=np.float32) if w % size == 0 else image[:, np.arange(size) * w // size].astype(np.float32)
    edges = np.arange(size) * h // size
    return np.add.reduceat(columns, edges, axis=0) / np.diff([*edges, h])[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which low-frequency cosine terms exceed their median; the mean has no say."""
    wave = _cosines(SHRUNK, KEPT)
    terms = (wave @ _shrink(image, SHRUNK) @ wave.T).round(2).ravel()
    terms[0] = 0
    return np.packbits(terms > np.median(terms)).tobytes().hex()


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text's padded UTF-8 as a PNG in a binary column."""

    def run(batches):
        for b in batches:
            size, media = [], []
            for cell in b.column(1):
                payload = (cell.as_py() or "").encode()
                size.append(len(payload))
                media.append(write_png(padded(payload)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, "key bigint, n_bytes bigint, media binary").withColumnRenamed("key", key)


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and the cosine hash of stored images, all from the bytes that are read back."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for cell in b.column(2):
                data = cell.as_py()
                image = read_png(data)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "key bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_batches(media.select(media[key].alias("key"), "n_bytes", "media"), run, schema).withColumnRenamed("key", key)


def store_and_read(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the media table to the shared folder, read it back and compute its features."""
    return media_features(stored(to_media(docs, text, key)), key)
