"""Removal of repeated passages with a sparse suffix array.

A byte goes if a string of ``LENGTH`` = 50 bytes covers it that also starts in a document with a
smaller id. Only suffixes at *anchors* are kept: in every 50-byte string the first of its 24-byte
grams with the smallest hash. Equal strings have their anchor at the same place, so the suffix at
the anchor and the few bytes before it say everything, with one suffix in about 14 bytes. A
document's consecutive strings with one anchor form a *run*, and the gram at the anchor is its head.

1. Texts are packed into parts of about ``Sizes.part`` bytes, written to the shared folder. A bounded
   sample of suffixes gives the splitters.
2. Short hashes of heads tell which occur in more than one document; nothing else is decided by them.
   A part sends the runs at such heads with their bytes to the bucket of their suffix, found by
   comparing it with the splitters byte by byte. Equal runs of a part are reduced to the
   smallest document's first, again by comparing bytes.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes at a step. Neighbours' longest
   common prefixes cut the order into ranges whose suffixes agree as far as a string reaches;
   within a range the bytes before the anchor are sorted the same way, and all but the smallest
   document of each group of equal strings lose that string.
4. Boundaries: suffixes that agree with a splitter as far as a string reaches may have equals on the
   other side. Each bucket sends one such string of each kind, and a grouped minimum over strings
   compares them across boundaries. Everything else is settled inside its bucket.
5. Spans meet their parts and are cut out.

Splitters may fall anywhere, so a frequent head is divided by the bytes that follow it, and a suffix
that is itself frequent makes several equal splitters, among which it is spread by part: a bucket
never gathers more than its share, whatever the texts. Splitters are one short row a bucket, as in
any range partitioning.

Defined results: null and empty texts lose nothing; documents shorter than 50 bytes neither lose
nor cause a loss; a text of any length is treated whole, within one part; rows with the same id never cost each other anything; null ids count as larger
than all others and as one id; further columns stay as they are, but for those with the name of a
computed figure, which the figure replaces; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablewise.llm.common import give_back, map_batches, stored

LENGTH, GRAM = 50, 24
#: Figures that are added to a document.
FIGURES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
#: Rows that a part holds at most.
PART_ROWS = 200_000
_LAST = (1 << 63) - 1
#: Bits of a position within a block, and of a head's hash that are sent (one more marks heads of several documents).
_POSITION, _SENT = 20, 39
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_BYTE_HASH, _OFFSET_HASH = np.random.default_rng(5).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
#: Masks that keep the first, or the last, so many bytes of a word.
_FIRST = np.array([(1 << 64) - (1 << 8 * (8 - n)) for n in range(9)], np.uint64)
_FINAL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FRONT, _BACK = 32, 64
#: Runs whose bytes are gathered at once; a byte takes some fifty then.
_GATHERED = 5_000


@dataclass(frozen=True)
class Sizes:
    """Bytes of text that a part, and a bucket, stands for; string starts hashed at once; strings
    compared at once; suffixes sampled for splitters; bits of hashes (candidates, equal runs) that
    are looked at: fewer of them cost time but change no result."""

    part: int = 8 << 20
    block: int = 1 << 18
    strings: int = 300_000
    sample: int = 60_000
    bits: int = 63


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A
    h ^= b
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of a size, put together from grams of powers of two."""
    level, n, made, done = _BYTE_HASH[data], 1, None, 0
    while True:
        if size & n:
            if made is None:
                made = level
            else:
                m = max(0, min(len(made), len(level) - done))
                made = _mix(made[:m], level[done : done + m])
            done += n
        if 2 * n > size:
            return made[: max(0, len(data) - size + 1)]
        level = _mix(level[:-n], level[n:]) if len(level) > n else level[:0]
        n *= 2


def find_runs(data: np.ndarray, end: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """First and last string start, anchor and head hash of all runs; texts end at ``end``."""
    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
    late = np.zeros(len(data) + 1, bool)
    tail = end[:, None] - np.arange(1, LENGTH)
    late[tail[tail >= begin[:, None]]] = True
    out = []
    width = LENGTH - GRAM + 1
    for at in range(0, len(data) - LENGTH + 1, block):
        head = gram_hashes(data[at : at + block + LENGTH - 1], GRAM)
        keyed = head >> np.uint64(_POSITION) << np.uint64(_POSITION) | np.arange(len(head), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            keyed = np.minimum(keyed[:-n], keyed[n:])
            n *= 2
        if n < width:
            keyed = np.minimum(keyed[: len(keyed) - (width - n)], keyed[width - n :])
        where = (keyed & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        own = late[at : at + len(where)]
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]) | own[:-1]
        first = np.flatnonzero(new & ~own)
        stop = np.append(np.flatnonzero(new | own), len(where))
        last = stop[np.searchsorted(stop, first, "right")] - 1
        out.append((first + at, last + at, where[first] + at, head[where[first]]))
    if not out:
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)
    columns = list(zip(*out))
    out.clear()
    return tuple(np.concatenate(columns.pop(0)) for _ in range(4))


def multikey_order(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over word columns: each step sorts only what is still tied.

    ``words`` are functions from row numbers to the next word. Gives the order and the group, in
    that order, of each row."""
    first = words[0](None)
    order = np.argsort(first, kind="stable")
    group = np.cumsum(np.concatenate([[0], np.diff(first[order]) != 0])) if len(order) else order
    for word in words[1:]:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        value = word(order[tied])
        inner = np.lexsort((value, group[tied]))
        order[tied] = order[tied][inner]
        fresh = np.zeros(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        value, own = value[inner], group[tied]
        fresh[tied[1:]] |= (own[1:] == own[:-1]) & (value[1:] != value[:-1])
        group = np.cumsum(fresh)
    return order, group


def _starts(group: np.ndarray) -> np.ndarray:
    """Where each group begins in an order."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def _split_by(slot: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(slot, columns' parts) for each slot."""
    order = np.argsort(slot, kind="stable")
    for own in np.split(order, _starts(slot[order])[1:]) if len(order) else ():
        yield int(slot[own[0]]), *(c[own] for c in columns)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that stand for ``count`` rows each: every row's item and its number within it."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _bytes_of(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs, one run after the other."""
    out = np.empty(int(size.sum()), np.uint8)
    done = 0
    for low in range(0, len(first), _GATHERED):
        own = slice(low, low + _GATHERED)
        _, shift = _spread(size[own])
        shift += np.repeat(first[own], size[own])
        out[done : done + len(shift)] = data[shift]
        done += len(shift)
    return out


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each key united where they overlap or touch."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    if not len(key):
        return key, start, stop
    # Ends so far, restarted for each key by lifting later keys above earlier ones.
    rank = np.cumsum(np.concatenate([[0], np.diff(key) != 0]))
    lift = rank * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    new = np.ones(len(key), bool)
    new[1:] = (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], start[at], np.maximum.reduceat(stop, at)


def returning(function):
    """A group function that gives memory back after each group."""

    def one(table):
        try:
            return function(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return function(left, right)
        finally:
            give_back()

    return one if function.__code__.co_argcount == 1 else two


# Words of suffixes --------------------------------------------------------------------------------


class Suffixes:
    """Runs' suffixes as words that sort as their bytes do, zeros beyond the end of the run."""

    def __init__(self, text: np.ndarray, anchor: np.ndarray, ahead: np.ndarray, size: np.ndarray):
        self.text, self.anchor, self.ahead, self.tail = text, anchor, ahead, size - ahead
        self.words = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))

    def after(self, k: int, rows=None) -> np.ndarray:
        anchor, tail = (self.anchor, self.tail) if rows is None else (self.anchor[rows], self.tail[rows])
        return self.words[anchor + 8 * k].astype(np.uint64) & _FIRST[np.clip(tail - 8 * k, 0, 8)]

    def before(self, k: int, rows: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """The k-th word before the anchor, of ``ahead`` bytes that count."""
        return self.words[self.anchor[rows] - 8 * (k + 1)].astype(np.uint64) & _FINAL[np.clip(ahead - 8 * k, 0, 8)]

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Order and groups of equal runs: by suffix, then by length and by the bytes ahead."""
        words = [lambda rows, k=k: self.after(k, rows) for k in range(7)]
        words.append(lambda rows: self.tail[rows].astype(np.uint64) << np.uint64(8) | self.ahead[rows].astype(np.uint64))
        words += [lambda rows, k=k: self.before(k, rows, self.ahead[rows]) for k in range(4)]
        return multikey_order(words)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """(n, 50) bytes of suffixes."""
        return np.stack([self.after(k, rows) for k in range(7)], 1).astype(">u8").view(np.uint8).reshape(len(rows), 56)[:, :LENGTH]


def common_prefix(a: list[np.ndarray], b: list) -> np.ndarray:
    """Bytes that suffixes, given as words, have in common (50 at most)."""
    out = np.full(len(a[0]), LENGTH, np.int64)
    for k in range(6, -1, -1):
        x = a[k] ^ b[k]
        lead = sum((x < np.uint64(1 << 8 * n)).astype(np.int64) for n in range(1, 8))
        out = np.where(x != 0, np.minimum(8 * k + lead, LENGTH), out)
    return out


def bucket_of(splitters: np.ndarray, words: np.ndarray, suffixes: Suffixes, salt: int) -> np.ndarray:
    """Bucket of each suffix: how many splitters are not above it. A suffix that equals several
    splitters goes to one of the buckets that they bound, by the salt."""
    lead = suffixes.after(0)
    low, out = np.searchsorted(words, lead, "left"), np.searchsorted(words, lead, "right")
    near = np.flatnonzero(low < out)
    if len(near):
        own = np.ascontiguousarray(suffixes.keys(near)).view(f"S{LENGTH}").ravel()
        low, high = np.searchsorted(splitters, own, "left"), np.searchsorted(splitters, own, "right")
        out[near] = np.where(high > low + 1, low + 1 + salt % np.maximum(1, high - low), high)
    return out


# Parts --------------------------------------------------------------------------------------------


def _tables(batches: Iterator[pa.RecordBatch], place: int, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        total = np.cumsum(pc.binary_length(b.column(place)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + most - size, "right")))
            held.append(b.slice(at, stop - at))
            size, rows, at = size + total[stop - 1] - before, rows + stop - at, stop
            if at < b.num_rows or size >= most or rows >= PART_ROWS:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the bytes of all texts (with room around them) and where each text ends in them."""
    bodies = table.column("text").cast(pa.binary()).to_pylist()
    data = np.frombuffer(b"".join([bytes(_FRONT), *bodies, bytes(_BACK)]), np.uint8)
    return table.column("doc").to_numpy(), data, np.cumsum([len(t) for t in bodies], dtype=np.int64)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Part:
    """A part's texts and runs; positions are those in the bytes of all its texts."""

    def __init__(self, table: pa.Table, slots: int, sizes: Sizes):
        self.doc, self.data, self.end = _texts(table)
        body = self.data[_FRONT : len(self.data) - _BACK]
        self.first, self.last, self.anchor, head = find_runs(body, self.end, sizes.block)
        #: The head's slot in the hash range, and the bits of its hash that are sent.
        head &= np.uint64((1 << sizes.bits) - 1)
        slot = (head >> np.uint64(_SENT)) * np.uint64(slots) >> np.uint64(63 - _SENT)
        self.code = slot << np.uint64(_SENT) | head & np.uint64((1 << _SENT) - 1)
        self.row = np.searchsorted(self.end, self.first, "right").astype(np.int32)
        self.size, self.ahead = self.last - self.first + LENGTH, self.anchor - self.first

    def suffixes(self) -> Suffixes:
        return Suffixes(self.data, self.anchor + _FRONT, self.ahead, self.size)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes of heads, and whether several documents here have each."""
        order = np.argsort(self.code, kind="stable")
        at = _starts(self.code[order])
        if not len(at):
            return self.code, np.zeros(0, bool)
        doc = self.doc[self.row[order]]
        other = doc != np.repeat(doc[at], np.diff(np.append(at, len(doc))))
        return self.code[order[at]], np.logical_or.reduceat(other, at)


def _parts(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(part, body): the rows in packed parts."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for table in _tables(batches, place, sizes.part):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_packed(table)], pa.binary())], ["part", "body"])
            part += 1

    place = docs.columns.index("text")
    return map_batches(docs, run, "part bigint, body binary")


def _sampled(parts: DataFrame, slots: int, sizes: Sizes) -> list[bytes]:
    """Suffixes of about ``sizes.sample`` runs, out of at most a hundred or so parts."""
    few = F.pmod(F.xxhash64("part"), F.lit(max(1, slots // 100))) == 0
    each = math.ceil(sizes.sample / min(slots, 100))

    def run(batches):
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = Part(_unpacked(body), slots, sizes)
                pick = np.random.default_rng(name).permutation(len(own.first))[:each]
                yield pa.RecordBatch.from_arrays([pa.array([own.suffixes().keys(pick).tobytes()], pa.binary())], ["keys"])

    return [r.keys for r in map_batches(parts.where(few).select("part", "body"), run, "keys binary").collect()]


def _heads(parts: DataFrame, slots: int, sizes: Sizes) -> DataFrame:
    """(part, slot, body): for each slot of the hash range a part's heads, as 39 bits of hash and a
    mark for those of several documents."""

    def run(batches):
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                code, several = Part(_unpacked(body), slots, sizes).heads()
                sent = code & np.uint64((1 << _SENT) - 1) | several.astype(np.uint64) << np.uint64(_SENT)
                rows = [(slot, c.astype("<u4").tobytes() + (c >> np.uint64(32)).astype("<u1").tobytes()) for slot, c in _split_by((code >> np.uint64(_SENT)).astype(np.int64), sent)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "slot", "body"])
                give_back()

    return map_batches(parts, run, "part bigint, slot int, body binary")


def _shared(heads: DataFrame) -> DataFrame:
    """(part, known): codes of a part's heads that another part has too."""

    def run(table: pa.Table) -> pa.Table:
        parts, bodies = table.column("part").to_pylist(), table.column("body").to_pylist()
        slot = table.column("slot")[0].as_py() if parts else 0
        n = np.array([len(b) // 5 for b in bodies], np.int64)
        sent = [np.frombuffer(b, "<u4", k).astype(np.uint64) | np.frombuffer(b, "<u1", k, 4 * k).astype(np.uint64) << np.uint64(32) for b, k in zip(bodies, n.tolist())]
        sent = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
        several, low = sent >> np.uint64(_SENT) != 0, sent & np.uint64((1 << _SENT) - 1)
        order = np.argsort(low, kind="stable")
        at = _starts(low[order])
        alone = np.repeat(np.diff(np.append(at, len(order))) == 1, np.diff(np.append(at, len(order))))
        pick = order[~alone & ~several[order]]
        owner = np.repeat(np.arange(len(n)), n)[pick]
        rows = [(parts[k], (low_ | np.uint64(slot << _SENT)).astype("<u8").tobytes()) for k, low_ in _split_by(owner, low[pick])]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "known"])

    return heads.groupBy("slot").applyInArrow(returning(run), "part bigint, known binary")


# Buckets ------------------------------------------------------------------------------------------

_MOVED = "bucket int, part bigint, n int, size bigint, body binary"
_SPANS = "part bigint, n int, body binary"


def _moved(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "part", "n", "size", "body"])


def _span_rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["part", "n", "body"])


def _span_body(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    return row.astype("<i4").tobytes() + start.astype("<i8").tobytes() + stop.astype("<i8").tobytes()


def _read(body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """Arrays of n items that stand one after the other; the last one may be as long as it likes."""
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(body, np.uint8, -1, at) if at < len(body) else np.zeros(0, np.uint8)]


def _equal_runs(part: Part, keep: np.ndarray, bits: int) -> np.ndarray:
    """Which of the runs have the same bytes as one of a smaller document in the part."""
    gone = np.zeros(len(keep), bool)
    order = np.argsort(part.code[keep], kind="stable")
    at = _starts(part.code[keep][order])
    count = np.diff(np.append(at, len(order)))
    some = keep[order[np.repeat(count > 1, count)]]
    name = np.zeros(len(some), np.uint64)
    for low in range(0, len(some), _GATHERED):
        own = some[low : low + _GATHERED]
        _, shift = _spread(part.size[own])
        value = _BYTE_HASH[part.data[np.repeat(part.first[own] + _FRONT, part.size[own]) + shift]] * _OFFSET_HASH[shift]
        sums = np.add.reduceat(value, np.cumsum(part.size[own]) - part.size[own])
        name[low : low + _GATHERED] = _mix(sums, part.code[own] + (part.size[own] << 8 | part.ahead[own]).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    doc = part.doc[part.row[some]]
    order = np.lexsort((doc, name))
    at = _starts(name[order])
    first = some[np.repeat(order[at], np.diff(np.append(at, len(order))))] if len(at) else some
    own, doc = some[order], doc[order]
    later = np.flatnonzero((doc > part.doc[part.row[first]]) & (part.size[own] == part.size[first]) & (part.ahead[own] == part.ahead[first]))
    same = np.zeros(len(later), bool)
    for low in range(0, len(later), _GATHERED):
        pick = later[low : low + _GATHERED]
        size = part.size[own[pick]]
        _, shift = _spread(size)
        a, b = (part.data[np.repeat(part.first[x[pick]] + _FRONT, size) + shift] for x in (own, first))
        same[low : low + _GATHERED] = np.logical_and.reduceat(a == b, np.cumsum(size) - size)
    gone[np.searchsorted(keep, own[later[same]])] = True
    return gone


def _candidates(parts: DataFrame, shared: DataFrame, splitters: np.ndarray, slots: int, sizes: Sizes) -> DataFrame:
    """Runs to compare by bucket, and spans of runs that are settled within their part (bucket < 0)."""
    words = np.frombuffer(b"".join(s[:8].ljust(8, b"\0") for s in splitters.tolist()), ">u8").astype(np.uint64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _moved([])
        name = left.column("part")[0].as_py()
        part = Part(_unpacked(left.column("body")[0].as_py()), slots, sizes)
        code, several = part.heads()
        known = np.concatenate([code[several], *(np.frombuffer(b, "<u8") for b in right.column("known").to_pylist())])
        keep = np.flatnonzero(np.isin(part.code, known))
        begin = np.concatenate([[0], part.end[:-1]]) if len(part.end) else part.end
        start = part.first - begin[part.row]
        gone = _equal_runs(part, keep, sizes.bits)
        rows = []
        if gone.any():
            out = keep[gone]
            spans = merged(part.row[out], start[out], start[out] + part.size[out])
            body = _span_body(*spans)
            rows.append((-1 - name % 65_521, name, len(spans[0]), len(body), body))
        keep = keep[~gone]
        every = part.suffixes()
        every.anchor, every.ahead, every.tail = every.anchor[keep], every.ahead[keep], every.tail[keep]
        slot = bucket_of(splitters, words, every, name * 0x9E3779B1 >> 7)
        for bucket, own in _split_by(slot, keep):
            size = part.size[own]
            text = _bytes_of(part.data, part.first[own] + _FRONT, size)
            arrays = (part.row[own].astype("<i4"), part.doc[part.row[own]].astype("<i8"), start[own].astype("<i8"), size.astype("<u1"), part.ahead[own].astype("<u1"), text)
            body = b"".join(a.tobytes() for a in arrays)
            rows.append((bucket, name, len(own), len(body), pa.compress(body, "zstd", asbytes=True)))
        return _moved(rows)

    return parts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(returning(run), _MOVED)


def _compared(moved: DataFrame, splitters: np.ndarray, sizes: Sizes) -> DataFrame:
    """(part, n, body): spans to remove; with a null part, strings that a boundary leaves open."""
    bounds = [np.frombuffer(s.ljust(56, b"\0"), ">u8").astype(np.uint64) for s in splitters.tolist()]

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows or table.column("bucket")[0].as_py() < 0:
            return table.select(["part", "n", "body"])
        bucket = table.column("bucket")[0].as_py()
        parts, n = table.column("part").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        got = [_read(pa.decompress(b.as_py(), s.as_py(), "zstd", asbytes=True), k, "<i4", "<i8", "<i8", "<u1", "<u1") for b, s, k in zip(table.column("body"), table.column("size"), n.tolist())]
        row, doc, start, size, ahead = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(5))
        text = np.concatenate([np.zeros(_FRONT, np.uint8), *(g[5] for g in got), np.zeros(_BACK, np.uint8)])
        got = None
        part = np.repeat(parts, n)
        anchor = _FRONT + np.cumsum(size) - size + ahead
        runs = Suffixes(text, anchor, ahead, size)
        order, group = runs.order()
        at = _starts(group)
        least = np.minimum.reduceat(doc[order], at)
        late = doc[order] > least[group]
        out = order[late]
        spans = [(part[out], row[out], start[out], start[out] + size[out])]

        # One run stands for all equal ones; those of the smallest document go on.
        own, own_group = order[~late], group[~late]
        member_at, members = np.searchsorted(own_group, np.arange(len(at))), np.bincount(own_group, minlength=len(at))
        rep = order[at]
        order = group = late = None
        suffix = [runs.after(k, rep) for k in range(7)]
        prefix = np.concatenate([[0], common_prefix([w[1:] for w in suffix], [w[:-1] for w in suffix])])
        edges = [bounds[k] for k in (bucket - 1, bucket) if 0 <= k < len(bounds)]
        edge = np.max([common_prefix(suffix, list(e)) for e in edges], 0) if edges else np.zeros(len(rep), np.int64)
        suffix = None
        head = np.cumsum(prefix < GRAM)
        chosen = np.flatnonzero((np.bincount(head)[head] > 1) | (edge >= LENGTH - ahead[rep]))
        count = size[rep[chosen]] - LENGTH + 1
        # Whole heads at a time, so that strings in memory stay few.
        share = np.cumsum(count) // sizes.strings
        cuts = np.flatnonzero((np.diff(share) > 0) & (np.diff(head[chosen]) > 0)) + 1 if len(chosen) else []
        rows: list[tuple] = []
        for mine in np.split(chosen, cuts) if len(chosen) else ():
            found, open_ = _late_strings(runs, rep[mine], least[mine], prefix[mine], edge[mine], size[rep[mine]] - LENGTH + 1)
            for k, (c, shift) in enumerate((found, open_)):
                c = mine[c]
                item, step = _spread(members[c])
                m, shift = own[member_at[c[item]] + step], shift[item]
                if k == 0:
                    spans.append((part[m], row[m], start[m] + shift, start[m] + shift + LENGTH))
                elif len(m):
                    strings = text[(anchor[m] - ahead[m] + shift)[:, None] + np.arange(LENGTH)]
                    rows.append((None, len(m), b"".join(x.tobytes() for x in (doc[m].astype("<i8"), part[m].astype("<i8"), row[m].astype("<i4"), (start[m] + shift).astype("<i8"), strings))))
        return _span_rows(rows + list(_by_part(*(np.concatenate(c) for c in zip(*spans)))))

    return moved.groupBy("bucket").applyInArrow(returning(run), _SPANS)


def _late_strings(runs: Suffixes, rep: np.ndarray, doc: np.ndarray, prefix: np.ndarray, edge: np.ndarray, count: np.ndarray) -> tuple[tuple, tuple]:
    """Strings of the runs ``rep``, which stand in suffix order, that a smaller document has too, and
    strings that may have equals across a boundary: each as (run, offset in the run).

    ``prefix`` is what each run's suffix has in common with the one before it. For a string with L
    bytes from the anchor on, equals lie in the range around it where that is L or more."""
    place = np.arange(len(rep))
    ranges = np.stack([np.maximum.accumulate(np.where(prefix < length, place, 0)) for length in range(GRAM, LENGTH + 1)])
    owner, shift = _spread(count)
    ahead = runs.ahead[rep][owner] - shift
    key = ranges[LENGTH - GRAM - ahead, owner] * (LENGTH + 1) + ahead
    words = [lambda rows: key if rows is None else key[rows]]
    words += [lambda rows, k=k: runs.before(k, rep[owner[rows]], ahead[rows]) for k in range(4)]
    order, group = multikey_order(words)
    mine = doc[owner[order]]
    late = mine > np.minimum.reduceat(mine, _starts(group))[group]
    found, rest = order[late], order[~late]
    rest = rest[edge[owner[rest]] >= LENGTH - ahead[rest]]
    return (owner[found], shift[found]), (owner[rest], shift[rest])


def _by_part(part: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple]:
    """Rows of _SPANS from spans."""
    for name, r, a, b in _split_by(part, row, start, stop):
        spans = merged(r, a, b)
        yield name, len(spans[0]), _span_body(*spans)


def _across(spans: DataFrame) -> DataFrame:
    """Spans of the strings that boundaries left open: a grouped minimum, joined back."""

    def unfold(batches):
        for b in batches:
            for n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc, part, row, start, rest = _read(body, n, "<i8", "<i8", "<i4", "<i8")
                strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), n, [None, pa.py_buffer(rest.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([strings, *map(pa.array, (doc, part, row, start))], ["string", "doc", "part", "row", "start"])

    def fold(batches):
        for b in batches:
            part, row, start = (b.column(k).to_numpy().astype(np.int64) for k in range(3))
            yield from _span_rows(list(_by_part(part, row, start, start + LENGTH))).to_batches()

    strings = map_batches(spans.select("n", "body"), unfold, "string binary, doc bigint, part bigint, row int, start bigint")
    least = strings.groupBy("string").agg(F.min("doc").alias("least"))
    return map_batches(strings.join(least, "string").where("doc > least").select("part", "row", "start"), fold, _SPANS)


def _splitters(sample: list[bytes], buckets: int) -> np.ndarray:
    every = np.sort(np.frombuffer(b"".join(sample), f"S{LENGTH}"))
    return every[np.arange(1, buckets) * len(every) // buckets] if len(every) else every


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", figures: Sequence[str] = FIGURES, sizes: Sizes = Sizes()) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and four figures: bytes, bytes removed,
    maximal removed runs, and the SHA-256 of the remaining bytes, under the names ``figures``. A
    cut may fall inside a character, whose rest is dropped from the returned text but not from the
    digest."""
    names = [c for c in docs.columns if c not in figures]
    kept_names = [f"c{i}" for i in range(len(names))]
    wide = docs.select(*[docs[c].alias(k) for c, k in zip(names, kept_names) if c != text], F.coalesce(docs[key].cast("bigint"), F.lit(_LAST)).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    passed = [c for c in wide.columns if c not in ("doc", "text")]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text])), F.lit(0))).first()[0]
    slots = max(1, math.ceil(total / sizes.part))
    parts = stored(_parts(wide, sizes))
    splitters = _splitters(_sampled(parts, slots, sizes), slots)
    moved = _candidates(parts, _shared(_heads(parts, slots, sizes)), splitters, slots, sizes)
    spans = stored(_compared(moved, splitters, sizes))
    closed, open_ = spans.where("part is not null"), spans.where("part is null")
    if open_.limit(1).count():
        closed = closed.unionByName(_across(open_))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        rows = _unpacked(left.column("body")[0].as_py())
        got = [_read(b, n, "<i4", "<i8", "<i8") for b, n in zip(right.column("body").to_pylist(), right.column("n").to_pylist())]
        row, start, stop = merged(*(np.concatenate([np.zeros(0, np.int64), *(g[k] for g in got)]) for k in range(3)))
        low = np.searchsorted(row, np.arange(rows.num_rows + 1)).tolist()
        start, stop, out, found = start.tolist(), stop.tolist(), [], []
        for k, data in enumerate(rows.column("text").cast(pa.binary()).to_pylist()):
            at, keep, removed = 0, [], 0
            for i in range(low[k], low[k + 1]):
                keep.append(data[at : start[i]])
                removed, at = removed + stop[i] - start[i], stop[i]
            rest = b"".join([*keep, data[at:]])
            out.append(rest.decode("utf-8", "ignore"))
            found.append((len(data), removed, low[k + 1] - low[k], hashlib.sha256(rest).hexdigest()))
        columns = [rows.column(c) for c in passed] + [pa.array(out, pa.string())] + [pa.array([f[k] for f in found], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])]
        return pa.table(columns, [*passed, "text", *FIGURES])

    added = [StructField(n, LongType()) for n in FIGURES[:3]] + [StructField(FIGURES[3], StringType())]
    schema = StructType([*(wide.schema[c] for c in passed), StructField("text", StringType()), *added])
    none = pa.table({})
    result = parts.groupBy("part").cogroup(closed.groupBy("part")).applyInArrow(returning(cut), schema)
    return result.select(*[(F.col("text") if c == text else F.col(k)).alias(c) for c, k in zip(names, kept_names)], *[F.col(f).alias(n) for f, n in zip(FIGURES, figures)])
