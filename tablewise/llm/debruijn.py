"""Removal of repeated word passages by compaction of a De Bruijn graph.

A word goes if a *window* of ``LENGTH`` = 50 words covers it that also starts in a document with a
smaller id. Windows are the edges of a De Bruijn graph, whose nodes are the 49 words that two
windows share; a document is a walk through it. Edges that occur in several documents and follow
each other wherever either occurs form one *path*, which is settled as a whole.

1. Texts are packed into parts of about ``Sizes.part`` bytes, written to the shared folder. The
   first of a window's 12-word grams with the smallest hash is its anchor, and a document's
   consecutive windows with one anchor form a *run*, so equal windows always meet at one gram.
2. A grouped minimum and maximum over grams tells which occur in more than one document. Only their
   runs become edges, as one row for each different run of a part, and equal rows of parts are
   added up before they move. A gram with more than ``Sizes.hot`` different runs is divided: its windows
   are dealt by themselves, by their own hash.
3. Where the edges of a gram meet, each learns whether several documents have it, and whether one and
   the same edge always comes before it, and after it. An edge's flags are joined to the parts that
   have it, and a document's edges are compacted: two neighbours grow together if the first is
   always followed by the second, and the second always preceded by the first. Every occurrence of
   an edge is then within an occurrence of its whole path.
4. Paths are verified at their source coordinates: each occurrence is named by a 128-bit digest of
   its words themselves. A grouped minimum gives a path's source (document and place), which is
   joined to the occurrences; those in larger documents are cut out.

Hashes of 64 bits only choose what is compared. Two different windows with one hash make a path end,
or are told apart by the digest: nothing is cut out that is not repeated.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; null, empty and short texts
lose nothing; a text of any length is treated whole, within one part; rows with the same id never
cost each other anything; null ids count as larger than all others and as one id; further columns
stay as they are, but for those with the name of a computed figure, which the figure replaces; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablewise.llm.common import give_back, map_batches, meet, stored
from tablewise.llm.suffixes import _packed, _tables, _unpacked, merged, returning

LENGTH, GRAM = 50, 12
#: Figures that are added to a document.
FIGURES = ("n_words", "n_removed", "kept_sha256")
_LAST = (1 << 63) - 1
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_HASH = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
#: Bits of a position within a block in which anchors are sought.
_POSITION = 20
#: What is known of an edge: several documents have it; always the same one before it; and after it.
REPEATED, ONE_BEFORE, ONE_AFTER = 1, 2, 4


@dataclass(frozen=True)
class Sizes:
    """Bytes of text of a part; bytes hashed at once; different runs beyond which a gram is divided.
    None of them changes a result."""

    part: int = 4 << 20
    block: int = 1 << 20
    hot: int = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX_A
    x = (x ^ (x >> np.uint64(29))) * _MIX_B
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def slice_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the slices of ``values``; equal slices have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    before = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=before[1:])
    sums = (before[stop] - before[start]) * _powers(_INVERSE, int(start[-1]) + 1)[start]
    return _mix(sums + (stop - start).astype(np.uint64) * _MIX_B)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes start and stop; the last byte is white space."""
    turns = np.flatnonzero(np.diff(_IS_WORD[data], prepend=np.int8(0)))
    return turns[::2], turns[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, block: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(stop, start[at] + block)))
        low = start[at]
        out[at:end] = slice_hashes(_BYTE_HASH[data[low : stop[end - 1]]], start[at:end] - low, stop[at:end] - low)
        at = end
    return out


def anchors(hashes: np.ndarray, width: int, block: int = 1 << 18) -> np.ndarray:
    """For each place, that of the first smallest among ``width`` hashes from there on."""
    out = []
    for at in range(0, len(hashes) - width + 1, block):
        keyed = hashes[at : at + block + width - 1] >> np.uint64(_POSITION) << np.uint64(_POSITION)
        keyed |= np.arange(len(keyed), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            keyed = np.minimum(keyed[:-n], keyed[n:])
            n *= 2
        if n < width:
            keyed = np.minimum(keyed[: len(keyed) - (width - n)], keyed[width - n :])
        out.append((keyed & np.uint64((1 << _POSITION) - 1)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _names(*columns: np.ndarray) -> np.ndarray:
    """(n, 2) words that name rows of numbers by 128 bits."""
    a = b = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        a, b = _mix(a * _MIX_B + c), _mix(b * _MIX_A ^ (c + _MIX_B))
    return np.stack([a, b], 1)


def _binary(names: np.ndarray) -> pa.Array:
    """128-bit names as binary values."""
    held = np.ascontiguousarray(names)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(held), [None, pa.py_buffer(held.tobytes())]).cast(pa.binary())


def _pieces(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Arrays of ``count`` numbers each as binary values."""
    offsets = np.concatenate([[0], np.cumsum(count * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as counted, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Part:
    """A part's words, windows and runs. Windows are known by the number of their first word."""

    def __init__(self, table: pa.Table, sizes: Sizes):
        self.table, self.doc = table, table.column("doc").to_numpy()
        self.bodies = table.column("text").cast(pa.binary()).to_pylist()
        data = np.frombuffer(b"\n".join([*self.bodies, b""]) or b"\n", np.uint8)
        start, stop = word_places(data)
        end = np.cumsum([len(b) + 1 for b in self.bodies], dtype=np.int64)
        row = np.searchsorted(end, start, "right")
        self.n_words = np.bincount(row, minlength=len(self.bodies)).astype(np.int64)
        self.begin = np.cumsum(self.n_words) - self.n_words
        self.row = row.astype(np.int32)
        words = word_hashes(data, start, stop, sizes.block)
        at = np.arange(max(0, len(words) - LENGTH + 1))
        self.edge = slice_hashes(words, at, at + LENGTH)
        at = np.arange(max(0, len(words) - GRAM + 1))
        gram = slice_hashes(words, at, at + GRAM)
        anchor = anchors(gram, LENGTH - GRAM + 1)
        n = len(self.edge)
        #: Windows that lie in one document; the numbers of neighbours beyond a document are 0.
        self.inside = self.row[:n] == self.row[LENGTH - 1 :] if n else np.zeros(0, bool)
        edge = np.where(self.inside, self.edge, np.uint64(0))
        same = np.zeros(n + 1, bool)
        same[1:n] = self.row[1:n] == self.row[: max(0, n - 1)]
        self.before = np.where(same[:n], np.concatenate([edge[:1], edge[:-1]]), np.uint64(0))
        self.after = np.where(same[1:], np.concatenate([edge[1:], edge[:1]]), np.uint64(0))
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~same[1:n]
        self.first = np.flatnonzero(new & self.inside)
        stops = np.append(np.flatnonzero(new | ~self.inside), n)
        self.count = stops[np.searchsorted(stops, self.first, "right")] - self.first
        self.gram = gram[anchor[self.first]]

    def run_names(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Runs' names: a run's first and last windows hold all of its words."""
        last = first + count - 1
        return _names(self.edge[first], self.edge[last], count.astype(np.uint64), self.before[first], self.after[last])

    def different(self, first: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of equal runs the first one: its key, place and count, name, and the least and the largest of their documents."""
        names = self.run_names(first, count)
        order = np.lexsort((names[:, 1], names[:, 0], key))
        own = names[order]
        at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1) | (key[order][1:] != key[order][:-1])])) if len(order) else order
        doc, one = self.doc[self.row[first[order]]], order[at]
        low, high = (f.reduceat(doc, at) if len(at) else doc for f in (np.minimum, np.maximum))
        return key[one], first[one], count[one], names[one], low, high


def _parts(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(part, body): the rows in packed parts."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for table in _tables(batches, place, sizes.part):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_packed(table)], pa.binary())], ["part", "body"])
            part += 1

    place = docs.columns.index("text")
    return map_batches(docs, run, "part bigint, body binary")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for b in batches:
        for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield name, _unpacked(body)


def _grams(parts: DataFrame, sizes: Sizes) -> DataFrame:
    """(gram, part, low, high, runs): each gram of a part with its documents' range and different runs."""

    def run(batches):
        for name, table in _bodies(batches):
            part = Part(table, sizes)
            key, _, _, _, low, high = part.different(part.first, part.count, part.gram)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            low, high = (f.reduceat(x, at) if len(at) else x for f, x in ((np.minimum, low), (np.maximum, high)))
            columns = [key[at].view(np.int64), np.full(len(at), name), low, high, np.diff(np.append(at, len(key)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "part", "low", "high", "runs"])
            give_back()

    return map_batches(parts, run, "gram bigint, part bigint, low bigint, high bigint, runs bigint")


_EDGES = "part bigint, at bigint, run binary, edges binary, low bigint, high bigint"


def _edges(parts: DataFrame, shared: DataFrame, sizes: Sizes) -> DataFrame:
    """A row for each different run of a part whose gram several documents have: where its edges meet
    (``at``), its name, its edges (with those before and after it), and its documents' range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        part = Part(_unpacked(left.column("body")[0].as_py()), sizes)
        grams, hot = right.column("gram").to_numpy().view(np.uint64), right.column("hot").to_numpy(zero_copy_only=False)
        order = np.argsort(grams)
        grams, hot = grams[order], hot[order]
        place = np.minimum(np.searchsorted(grams, part.gram), len(grams) - 1)
        known = grams[place] == part.gram
        whole, divided = known & ~hot[place], known & hot[place]
        windows = _ranges(part.first[divided], part.count[divided])
        first = np.concatenate([part.first[whole], windows])
        count = np.concatenate([part.count[whole], np.ones(len(windows), np.int64)])
        key = np.concatenate([part.gram[whole], part.edge[windows]])
        key, first, count, names, low, high = part.different(first, count, key)
        values = np.zeros(int(count.sum()) + 2 * len(count), np.uint64)
        at = np.cumsum(count + 2) - count - 2
        values[at], values[at + count + 1] = part.before[first], part.after[first + count - 1]
        values[_ranges(at + 1, count)] = part.edge[_ranges(first, count)]
        columns = [pa.array(np.full(len(key), left.column("part")[0].as_py()), pa.int64()), pa.array(key.view(np.int64)), _binary(names), _pieces(values, count + 2), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
        return pa.table(columns, none.column_names)

    none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())], ["part", "at", "run", "edges", "low", "high"])
    return parts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(returning(run), _EDGES)


def _flags(edges: DataFrame, slots: int) -> DataFrame:
    """(run, n, flags): for each different run how many parts have it, and a byte for each edge."""
    merged_runs = edges.groupBy("run", "at").agg(F.first("edges").alias("edges"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n"))

    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("edges").to_pylist()
        count = np.array([len(b) // 8 - 2 for b in bodies], np.int64)
        values = np.frombuffer(b"".join(bodies), np.uint64)
        place = _ranges(np.cumsum(count + 2) - count - 1, count)
        edge, before, after = values[place], values[place - 1], values[place + 1]
        low, high = (np.repeat(table.column(c).to_numpy(), count) for c in ("low", "high"))
        order = np.argsort(edge, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], edge[order][1:] != edge[order][:-1]])) if len(order) else order
        flags = np.zeros(len(order), np.uint8)
        if len(at):
            several = np.minimum.reduceat(low[order], at) != np.maximum.reduceat(high[order], at)
            one = [np.minimum.reduceat(x[order], at) == np.maximum.reduceat(x[order], at) for x in (before, after)]
            known = several * REPEATED + one[0] * ONE_BEFORE + one[1] * ONE_AFTER
            flags[order] = np.repeat(known, np.diff(np.append(at, len(order))))
        return pa.table([table.column("run"), table.column("n"), _pieces(flags, count)], ["run", "n", "flags"])

    slot = F.pmod(F.xxhash64("at"), F.lit(slots)).cast("int").alias("slot")
    return merged_runs.select("run", "n", "edges", "low", "high", slot).groupBy("slot").applyInArrow(returning(run), "run binary, n bigint, flags binary")


_PATHS = "digest binary, doc bigint, part bigint, row int, start bigint, words bigint"


def _paths(parts: DataFrame, flags: DataFrame, sizes: Sizes) -> DataFrame:
    """Occurrences of compacted paths, named by digests of their words: (digest, doc, part, row, start, words)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        name, part = left.column("part")[0].as_py(), Part(_unpacked(left.column("body")[0].as_py()), sizes)
        bodies = right.column("flags").to_pylist()
        given, size = np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies], np.int64)
        at, of = np.cumsum(size) - size, np.frombuffer(b"".join(right.column("run").to_pylist()), np.uint64).reshape(-1, 2)
        order = np.lexsort((of[:, 1], of[:, 0]))
        at, of, size = at[order], of[order], size[order]
        state = np.zeros(len(part.edge) + 1, np.uint8)

        def learn(first: np.ndarray, count: np.ndarray) -> np.ndarray:
            names = part.run_names(first, count)
            place = np.minimum(np.searchsorted(of[:, 0], names[:, 0]), len(of) - 1)
            # Names whose first half repeats stand next to each other.
            for _ in range(8):
                place = np.where((of[place] != names).any(1) & (of[np.minimum(place + 1, len(of) - 1), 0] == names[:, 0]), np.minimum(place + 1, len(of) - 1), place)
            hit = (of[place] == names).all(1) & (size[place] == count)
            state[_ranges(first[hit], count[hit])] = given[_ranges(at[place[hit]], count[hit])]
            return hit

        hit = learn(part.first, part.count)
        rest = _ranges(part.first[~hit], part.count[~hit])
        learn(rest, np.ones(len(rest), np.int64))
        here = np.flatnonzero(state & REPEATED)
        if not len(here):
            return none
        prior = np.maximum(here - 1, 0)
        grown = (here > 0) & (part.row[prior] == part.row[here]) & (state[prior] & REPEATED > 0) & (state[prior] & ONE_AFTER > 0) & (state[here] & ONE_BEFORE > 0)
        begins = np.flatnonzero(~grown)
        start, count = here[begins], np.diff(np.append(begins, len(here)))
        row = part.row[start]
        own = start - part.begin[row]
        digests, of_row, words = [], -1, []
        for r, a, z in zip(row.tolist(), own.tolist(), (own + count + LENGTH - 1).tolist()):
            if r != of_row:
                of_row, words = r, part.bodies[r].split()
            digests.append(hashlib.blake2b(b" ".join(words[a:z]), digest_size=16).digest())
        columns = [pa.array(digests, pa.binary()), pa.array(part.doc[row], pa.int64()), pa.array(np.full(len(row), name), pa.int64()), pa.array(row, pa.int32()), pa.array(own, pa.int64()), pa.array(count + LENGTH - 1, pa.int64())]
        return pa.table(columns, none.column_names)

    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    none = pa.table([pa.array([], t) for t in kinds], ["digest", "doc", "part", "row", "start", "words"])
    return parts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(returning(run), _PATHS)


def _spans(parts: DataFrame, slots: int, sizes: Sizes) -> DataFrame:
    """(doc, part, row, start, words, source): occurrences of paths in other than their first document."""
    grams = stored(_grams(parts, sizes))
    known = grams.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("runs").alias("runs")).where("low < high")
    shared = grams.select("gram", "part").join(known.select("gram", (F.col("runs") > sizes.hot).alias("hot")), "gram")
    edges = stored(_edges(parts, shared, sizes))
    flags = stored(_flags(edges, slots))
    paths = stored(_paths(parts, meet(edges.select("part", "run"), flags, "run", "n", "flags"), sizes))
    first = paths.groupBy("digest").agg(F.min(F.struct("doc", "part", "row", "start")).alias("source"), F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).where("last > source.doc")
    found = meet(paths, stored(first), "digest", "n", "source")
    return found.where("doc > source.doc").drop("digest")


def _packs(docs: DataFrame, text: str, key: str, figures: Sequence[str], sizes: Sizes):
    names = [c for c in docs.columns if c not in figures]
    kept = [f"c{i}" for i in range(len(names))]
    wide = docs.select(*[docs[c].alias(k) for c, k in zip(names, kept) if c != text], F.coalesce(docs[key].cast("bigint"), F.lit(_LAST)).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text])), F.lit(0))).first()[0]
    return names, kept, wide, stored(_parts(wide, sizes)), max(1, math.ceil(total / sizes.part))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", sizes: Sizes = Sizes()) -> DataFrame:
    """(doc, start, words, source_doc, source_start): for each occurrence of a compacted path the words
    that it takes up, and the smallest document's first occurrence; null ids are given as 2^63 - 1."""
    *_, parts, slots = _packs(docs, text, key, (), sizes)
    return _spans(parts, slots, sizes).select("doc", "start", "words", F.col("source.doc").alias("source_doc"), F.col("source.start").alias("source_start"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", figures: Sequence[str] = FIGURES, sizes: Sizes = Sizes()) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, whose remaining words are joined by one
    space, and three figures under the names ``figures``: words, words removed, and the SHA-256 of
    the new text. Texts that lose nothing are joined anew as well."""
    names, kept_names, wide, parts, slots = _packs(docs, text, key, figures, sizes)
    passed = [c for c in wide.columns if c not in ("doc", "text")]
    spans = stored(_spans(parts, slots, sizes).select("part", "row", "start", "words"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        rows = _unpacked(left.column("body")[0].as_py())
        row, start, stop = merged(*(right.column(c).to_numpy().astype(np.int64) for c in ("row", "start")), (right.column("start").to_numpy() + right.column("words").to_numpy()).astype(np.int64))
        low = np.searchsorted(row, np.arange(rows.num_rows + 1)).tolist()
        start, stop, out, found = start.tolist(), stop.tolist(), [], []
        for k, data in enumerate(rows.column("text").cast(pa.binary()).to_pylist()):
            words, at, keep = data.split(), 0, []
            for i in range(low[k], low[k + 1]):
                keep += words[at : start[i]]
                at = stop[i]
            keep = keep + words[at:] if at else words
            rest = b" ".join(keep)
            out.append(rest.decode())
            found.append((len(words), len(words) - len(keep), hashlib.sha256(rest).hexdigest()))
        columns = [rows.column(c) for c in passed] + [pa.array(out, pa.string())] + [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table(columns, [*passed, "text", *FIGURES])

    added = [StructField(n, LongType()) for n in FIGURES[:2]] + [StructField(FIGURES[2], StringType())]
    schema = StructType([*(wide.schema[c] for c in passed), StructField("text", StringType()), *added])
    none = pa.table({})
    result = parts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(returning(cut), schema)
    return result.select(*[(F.col("text") if c == text else F.col(k)).alias(c) for c, k in zip(names, kept_names)], *[F.col(f).alias(n) for f, n in zip(FIGURES, figures)])
