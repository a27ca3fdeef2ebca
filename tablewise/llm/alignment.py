"""Alignment of the tokens of two public tokenizers over the same bytes.

Tokenizer A is a byte-level BPE, B a BPE of pieces with byte fallback. A text with one space before it
is encoded by both; where tokens of both end at one byte, the text is cut into groups.

1. Texts are encoded in parts of about ``Sizes.part`` bytes. Ends of tokens are running sums of token
   lengths. The shorter of a text's two lists of ends drives a galloping search through the longer:
   exponential steps from a place that is known to lie before, then halving between the last two.
   Every ``Sizes.stride``-th end gallops from the text's start, and those between from there.
2. Common ends are the groups' cuts; the differences of their ranks in the lists say how many tokens
   of each kind a group has. The two tokens that end at a cut are linked.
3. A part's links are counted by pair; a grouped sum over all parts gives each pair's count and each
   B id's largest. Both are joined back to the parts' pairs, and to documents within their part. A pair is
   one row a part, so no key holds more rows than there are parts.

A piece never reaches from a character into a space after it (checked when the model is read), so B is
applied to each different run of spaces and what follows it once a part.

Defined results: a null or empty text has no tokens, and neither has one whose bytes A or B does not
give back (such as one with U+2581, which B reads as a space); numbers are then 0 and the digest ''.
Null and repeated ids stay, a row each; a text of any length is treated whole, within one part; other
columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewise.llm.common import give_back, map_batches, stored
from tablewise.llm.suffixes import _packed, _tables, _unpacked, returning

_SPACED = re.compile(" +[^ ]*")
#: The bytes that a byte-level vocabulary writes as the character of the same number.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


@dataclass(frozen=True)
class Sizes:
    """Bytes of text of a part; bytes encoded at once; ends between those that gallop from a text's
    start. None of them changes a result."""

    part: int = 16 << 20
    batch: int = 2 << 20
    stride: int = 16


def common_ends(a: np.ndarray, b: np.ndarray, a_begin: np.ndarray, b_begin: np.ndarray, stride: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both have.

    Both hold the ends of several texts, one after the other, which begin at the places ``a_begin``
    and ``b_begin``; of each text the shorter list drives."""
    n_a, n_b = np.diff(np.append(a_begin, len(a))), np.diff(np.append(b_begin, len(b)))
    found = []
    for drives, own, other, begin, size, other_begin, turned in ((n_a <= n_b, a, b, a_begin, n_a, b_begin, False), (n_a > n_b, b, a, b_begin, n_b, a_begin, True)):
        size = size[drives]
        text, at = np.repeat(np.arange(len(size)), size), np.arange(int(size.sum()))
        at = at - np.repeat(np.cumsum(size) - size, size)
        place = begin[drives][text] + at
        value, rank = own[place], np.zeros(len(place), np.int64)
        heads = np.flatnonzero(at % stride == 0)
        rank[heads] = gallop(value[heads], other, other_begin[drives][text[heads]])
        rest = np.flatnonzero(at % stride)
        rank[rest] = gallop(value[rest], other, rank[rest - at[rest] % stride])
        hit = (rank < len(other)) & (other[np.minimum(rank, len(other) - 1)] == value) if len(other) else np.zeros(len(place), bool)
        found.append((rank[hit], place[hit]) if turned else (place[hit], rank[hit]))
    in_a, in_b = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def gallop(value: np.ndarray, other: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each value the first place in ``other`` that is not below it, and not before ``low``.

    Steps double until the value is reached; then the range of the last step is halved."""
    low, high = low.copy(), low.copy()
    active, step = np.arange(len(value)), 1
    while len(active):
        below = high[active] < len(other)
        below[below] = other[high[active[below]]] < value[active[below]]
        active = active[below]
        low[active] = high[active] + 1
        high[active] += step
        step *= 2
    high = np.minimum(high, len(other))
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        below = other[middle] < value[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


def byte_vocabulary(path: str) -> list[bytes]:
    """Each id's bytes in a byte-level vocabulary, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    rest = [b for b in range(256) if b not in _PRINTED]
    byte_of = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}
    names = sorted((i, t) for t, i in model["model"]["vocab"].items() if t not in special)
    return [bytes(byte_of[c] for c in t) for _, t in names]


class _Digits:
    """Decimal forms of ids as rows of bytes, with a place for a separator."""

    def __init__(self, n: int):
        texts = [str(i).encode() for i in range(n)]
        self.size = np.array([len(t) for t in texts], np.int64)
        self.width = int(self.size.max(initial=1)) + 1
        self.rows = np.frombuffer(b"".join(t.ljust(self.width) for t in texts), np.uint8).reshape(n, self.width)


class Tokenizers:
    """Both tokenizers and the bytes of their ids. ``pattern`` splits texts for A."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        tokens = byte_vocabulary(byte_path)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        self.byte_path = byte_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece reaches from a character into a space")
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (tokens, self.b_bytes))
        self.a_digits, self.b_digits = _Digits(len(self.a_size)), _Digits(len(self.b_size))

    @functools.cached_property
    def slow_a(self) -> Tokenizer:
        slow = Tokenizer.from_file(self.byte_path)
        slow.encode_special_tokens = True
        return slow

    def encode_a(self, text: str) -> np.ndarray:
        """A's ids. The faster library gives up on several hundred thousand white-space characters in a
        row; the other one, of the same vocabulary, does not."""
        try:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            return np.array(self.slow_a.encode(text, add_special_tokens=False).ids, np.int64)


@functools.lru_cache(1)
def tokenizers(byte_path: str, piece_path: str, pattern: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path, pattern)


class Pieces:
    """B's ids of runs of spaces and what follows them, each encoded once."""

    def __init__(self, both: Tokenizers):
        self.both, self.known = both, {}
        self.ids, self.first, self.count, self.same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def places(self, runs: list[str]) -> np.ndarray:
        new = [r for r in dict.fromkeys(runs) if r not in self.known]
        if new:
            # B puts a space before what it gets; a single space at the end of a text is all there is.
            got = [x if r != " " else [self.both.b.piece_to_id("▁")] for r, x in zip(new, self.both.b.encode([r[1:] for r in new], num_threads=1))]
            count = np.array([len(x) for x in got], np.int64)
            same = [b"".join([self.both.b_bytes[i] for i in x]) == r.encode() for r, x in zip(new, got)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count, self.same = np.concatenate([self.count, count]), np.concatenate([self.same, same])
            self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.int32)])
        return np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and whether its bytes come back."""
        split = [_SPACED.findall(t) for t in texts]
        place, size = self.places([r for x in split for r in x]), np.array([len(x) for x in split], np.int64)
        count = self.count[place]
        taken = np.repeat(self.first[place] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        begin = np.cumsum(size) - size
        if not len(texts):
            return np.zeros(0, np.int32), size, np.zeros(0, bool)
        return self.ids[taken], np.add.reduceat(count, begin), np.logical_and.reduceat(self.same[place], begin)


class Aligned:
    """Tokens, cuts and links of some texts; those that do not come back have no tokens."""

    def __init__(self, texts: list[str | None], both: Tokenizers, pieces: Pieces, stride: int):
        self.both = both
        filled = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in filled]
        b, n_b, same = pieces.encode(spaced)
        got = [both.encode_a(t) if ok else np.zeros(0, np.int64) for t, ok in zip(spaced, same.tolist())]
        n_a = np.array([len(x) for x in got], np.int64)
        a = np.concatenate([np.zeros(0, np.int64), *got])
        bytes_a = np.bincount(np.repeat(np.arange(len(filled)), n_a), both.a_size[a], len(filled))
        same &= bytes_a == [len(t.encode()) for t in spaced]
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        n_a, n_b = n_a * same, n_b * same
        a_begin, b_begin = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        a_ends, b_ends = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        self.a, self.b = a, b.astype(np.int64)
        self.cut_a, self.cut_b = common_ends(a_ends, b_ends, a_begin, b_begin, stride)
        groups = np.bincount(np.repeat(np.arange(len(filled)), n_a)[self.cut_a], minlength=len(filled))
        self.n_a, self.n_b, self.n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        self.n_a[filled], self.n_b[filled], self.n_groups[filled] = n_a, n_b, groups

    def links(self) -> np.ndarray:
        """Pairs of ids, as one number, of the tokens that end at each cut."""
        return self.a[self.cut_a] << 32 | self.b[self.cut_b]

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text, '' without tokens."""
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.cut_a], ends_b[self.cut_b] = True, True
        # Where a token stands: after the other kind's tokens of all groups before (B: of its own too).
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.cut_b + 1])[group_a]
        place_b = np.arange(len(self.b)) + self.cut_a[group_b] + 1
        sides = (self.a, place_a, np.where(ends_a, ord("|"), ord(",")), self.both.a_digits), (self.b, place_b, np.where(ends_b, ord(";"), ord(",")), self.both.b_digits)
        width, total = max(s[3].width for s in sides), len(self.a) + len(self.b)
        cells, size = np.zeros((total, width), np.uint8), np.zeros(total, np.int64)
        for ids, place, mark, digits in sides:
            cells[place, : digits.width] = digits.rows[ids]
            size[place] = digits.size[ids]
            cells[place, digits.size[ids]] = mark
        written = cells[np.arange(width) <= size[:, None]]
        last = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [hashlib.sha256(written[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(last, last[1:])]


def _wide(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(docs[key].cast("bigint").alias("doc"), docs[text].alias("text"))


def _aligned(table: pa.Table, both: Tokenizers, sizes: Sizes) -> Iterator[tuple[pa.Table, Aligned]]:
    pieces = Pieces(both)
    for part in _tables(iter(table.to_batches()), 1, sizes.batch):
        yield part, Aligned(part.column("text").to_pylist(), both, pieces, sizes.stride)


def _listed(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int64()), pa.array(values))


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, text: str = "text", key: str = "doc_id", sizes: Sizes = Sizes()) -> DataFrame:
    """(key, a_ids, b_ids, a_stops, b_stops): all tokens, and after how many of each kind a group ends."""

    def run(batches):
        both = tokenizers(byte_path, piece_path, pattern)
        for table in _tables(batches, 1, sizes.part):
            for part, found in _aligned(table, both, sizes):
                begin_a, begin_b = (np.repeat(np.cumsum(n) - n, found.n_groups) for n in (found.n_a, found.n_b))
                lists = (found.a, found.n_a), (found.b, found.n_b), (found.cut_a + 1 - begin_a, found.n_groups), (found.cut_b + 1 - begin_b, found.n_groups)
                columns = [part.column("doc").combine_chunks(), *(_listed(v, n).cast(pa.list_(pa.int32())) for v, n in lists)]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [key, "a_ids", "b_ids", "a_stops", "b_stops"])

    return map_batches(_wide(docs, text, key), run, f"{key} bigint, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>")


def _parts(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, sizes: Sizes) -> DataFrame:
    """A part's documents and their links, packed (``body``), and a row for each pair that it has."""

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        both = tokenizers(byte_path, piece_path, pattern)
        for table in _tables(batches, 1, sizes.part):
            held, links = [], []
            for part, found in _aligned(table, both, sizes):
                figures = dict(doc=part.column("doc"), n_a=found.n_a, n_b=found.n_b, n_groups=found.n_groups, groups_sha256=found.digests())
                held.append(pa.table(figures))
                links.append(found.links())
            pair, at, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            rows = pa.concat_tables(held)
            rows = rows.append_column("links", _listed(at.astype(np.uint32), rows.column("n_groups").to_numpy()))
            # One row of text to a batch keeps what is sent at once small.
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([_packed(rows)], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], ["part", "body", "pair", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), name), pa.int64()), pa.nulls(len(pair), pa.binary()), pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["part", "body", "pair", "n"])
            name += 1
            held, links = [], []
            give_back()

    return map_batches(docs, run, "part bigint, body binary, pair bigint, n bigint")


def _rated(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair over all parts, and whether its B id has none that is more frequent."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, text: str = "text", key: str = "doc_id", sizes: Sizes = Sizes()) -> DataFrame:
    """(a_id, b_id, count, best): how many links hold each pair of ids, and whether no other pair of
    that B id has more."""
    pairs = _parts(_wide(docs, text, key), byte_path, piece_path, pattern, sizes).where("pair is not null")
    return _rated(stored(pairs)).select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "count", "best")


_FIGURES = (("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()))


def align(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, text: str = "text", key: str = "doc_id", sizes: Sizes = Sizes()) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each document."""
    parts = stored(_parts(_wide(docs, text, key), byte_path, piece_path, pattern, sizes))
    pairs = parts.where("pair is not null").select("part", "pair", "n")
    back = pairs.select(F.col("part").alias("home"), "pair").join(stored(_rated(pairs)), "pair")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        rows = _unpacked(left.column("body")[0].as_py()).combine_chunks()
        order = np.argsort(right.column("pair").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        links = np.concatenate([np.zeros(0, np.uint32), *(c.flatten().to_numpy() for c in rows.column("links").chunks)])
        n = rows.column("n_groups").to_numpy()
        stop = np.cumsum(n)
        sums = [np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)]) for x in (best, count)]
        n_best, count_sum = (s[stop] - s[stop - n] for s in sums)
        return pa.table([rows.column("doc"), rows.column("n_a"), rows.column("n_b"), rows.column("n_groups"), pa.array(n), pa.array(n_best), pa.array(count_sum), rows.column("groups_sha256")], none.column_names)

    none = pa.table([pa.array([], t) for _, t in _FIGURES], [c for c, _ in _FIGURES])
    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'bigint'}" for c, t in _FIGURES)
    bodies = parts.where("body is not null").select("part", "body")
    return bodies.groupBy("part").cogroup(back.groupBy("home")).applyInArrow(returning(run), schema).withColumnRenamed("doc", key)
