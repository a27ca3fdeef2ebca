"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A word enters symbol by symbol. For every prefix the last token of its encoding is unique: it is
the one token that ends there and is *stable* next to the last token of the prefix before it,
meaning that merging the two of them alone gives the same two back. So each new symbol adds one
(token, start) link, and a token leaves the transducer once the links of all prefixes that a later
token can still attach to run through it. The window that has to be kept follows from the merge
list (``MergeTable.lookahead``), so memory does not grow with the length of a word.

Encoding follows the tokenizer file: special tokens are cut out of the raw text, then NFC, white
space, lower case, word pattern, byte alphabet, end-of-word suffix. Decoding is a state machine
over token ids that gives text as ids arrive.

Defined results: null and empty texts give no tokens, an empty id string and empty decoded text;
texts of any length are processed whole; equal texts give equal rows; null and repeated ids stay, a
row each, whatever their texts; further input columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import batched
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablewise.llm.common import give_back, map_batches, slices

#: Remembered encodings of white-space-delimited chunks, a bound per task.
MEMO_ENTRIES = 700_000
#: Chunks that are encoded together, in sorted order.
LEARN_CHUNKS = 100_000
#: Chunks longer than this are not remembered; they stream through the transducer.
MEMO_CHARS = 64
#: Texts that a task holds at once.
TEXTS = 500
#: White space of the word pattern, which str.split() exceeds by four control characters.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_EXTRA_SPACE = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class MergeTable:
    """What encoding needs of a tokenizer file; small and bounded, so it is shipped with the job."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern: str = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.decoder: str = (spec.get("decoder") or {}).get("type", "")
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.append((self.vocab[left], self.vocab[right], self.vocab[left + right]))
        self.longest = max(self.length(i) for i in self.vocab.values())
        self.lookahead = self._lookahead()

    def length(self, token: int) -> int:
        """Symbols in a token; the end-of-word suffix belongs to its last symbol."""
        name = self.names[token]
        return len(name) - len(self.suffix) if self.suffix and name.endswith(self.suffix) and name != self.suffix else len(name)

    def _lookahead(self) -> int:
        """Longest way, in symbols, that a change at the right can travel to the left.

        A merge (u, v) fails only if v is first taken from the right by a merge of smaller rank, so
        changes travel along merges of rising rank that share an operand: one pass in rank order.
        """
        reach: dict[int, int] = {}
        most = self.longest
        for left, right, _ in self.merges:
            way = self.length(left) + max(self.length(right), reach.get(right, 0))
            reach[left] = max(reach.get(left, 0), way)
            most = max(most, way)
        return most


class Transducer:
    """Encodes one word after another; the state between symbols is bounded by the lookahead."""

    def __init__(self, table: MergeTable):
        self.table, self.vocab, self.suffix = table, table.vocab, table.suffix
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(table.merges)}
        self.longest = table.longest
        self.window = table.lookahead + table.longest
        self.never = len(table.merges)
        self.ending = {name[: table.length(i)]: i for name, i in table.vocab.items() if name.endswith(table.suffix)} if table.suffix else table.vocab
        self.left = {c: (a, r) for r, (a, _, c) in enumerate(table.merges)}
        self.right = {c: (b, r) for r, (_, b, c) in enumerate(table.merges)}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that form a token's left (0) or right (1) end, largest first, each with the
        rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            halves, piece, until, known = (self.left, self.right)[side], token, self.never, []
            while True:
                known.append((piece, until))
                if piece not in halves:
                    break
                piece, until = halves[piece]
            self.edges[side][token] = known
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side (left -1: at a word's start).

        They do unless some merge across the border comes before the merges that take up the two
        pieces it would join; of equal ranks the one further left comes first.
        """
        key = (left + 1) << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            known, rank = True, self.rank
            if left >= 0:
                ends = self.edge(right, 0)
                for p, p_until in self.edge(left, 1):
                    for q, q_until in ends:
                        r = rank.get(p << 20 | q)
                        if r is not None and r < p_until and r <= q_until:
                            known = False
            self.pairs[key] = known
        return known

    def step(self, word: str, i: int, base: int, last: list[int], final: bool) -> tuple[int, int]:
        """The last token, and where it begins, of the prefix of length i (-2: it has none)."""
        get, pairs = (self.ending if final else self.vocab).get, self.pairs
        for j in range(i - 1, max(base, i - self.longest) - 1, -1):
            token = get(word[j:i])
            if token is not None and (before := last[j - base]) != -2:
                known = pairs.get((before + 1) << 20 | token)
                if known or known is None and self.stable(before, token):
                    return token, j
        return -2, -1

    def encode(self, word: str) -> Iterator[int]:
        """Tokens of one word (characters of the byte alphabet), each as soon as it is settled."""
        n, base = len(word), 0  # base: symbols already emitted
        last, start = [-1], [0]  # of the prefix of length base + i
        for i in range(1, n + 1):
            token, j = self.step(word, i, base, last, i == n)
            last.append(token)
            start.append(j)
            if i - base >= 2 * self.window and i < n:
                settled = self._settled(last, start, base, i)
                if settled > base:
                    yield from self._walk(last, start, base, settled)
                    keep = settled - base
                    last, start, base = last[keep:], start[keep:], settled
        yield from self._walk(last, start, base, n)

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Tokens of each of many sorted short words; a word resumes at the prefix that it shares
        with the one before, whose links are still there."""
        last, start, before = [-1], [0], ""
        for word in words:
            n, keep = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                keep += 1
            keep = min(keep, n - 1)
            del last[keep + 1 :], start[keep + 1 :]
            for i in range(keep + 1, n):
                token, j = self.step(word, i, 0, last, False)
                last.append(token)
                start.append(j)
            token, j = self.step(word, n, 0, last, True)
            yield [*self._walk(last, start, 0, j), token]
            before = word[: n - 1]

    def _settled(self, last: list[int], start: list[int], base: int, i: int) -> int:
        """The last boundary that the links of all open prefixes share."""
        common: set[int] | None = None
        for at in range(i - self.longest + 1, i + 1):
            if last[at - base] == -2:
                continue
            chain = {at}
            while at > base:
                at = start[at - base]
                chain.add(at)
            common = chain if common is None else common & chain
        return max(common or {base})

    @staticmethod
    def _walk(last: list[int], start: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = start[end - base]
        return out[::-1]


class Encoder:
    """Text to the little-endian bytes of its token ids."""

    def __init__(self, table: MergeTable):
        self.table, self.transducer = table, Transducer(table)
        self.shown = dict(enumerate(byte_alphabet()))
        self.words = regex.compile(table.pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")") if table.special else None
        self.memo: dict[str, bytes] = {}

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk without white space, in the byte alphabet."""
        found = [chunk] if chunk.isalpha() else self.words.findall(chunk)
        return found if chunk.isascii() and chunk.isprintable() else [w.encode().decode("latin-1").translate(self.shown) for w in found]

    def learn(self, chunks: Iterable[str]) -> None:
        """Put chunks into the memo; their words are encoded in sorted order."""
        parts = {c: self.split(c) for c in chunks if len(c) <= MEMO_CHARS}
        words = sorted({w for p in parts.values() for w in p})
        ids = {w: pack(f"<{len(t)}I", *t) for w, t in zip(words, self.transducer.encode_sorted(words))}
        self.memo.update((c, ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p])) for c, p in parts.items())

    def long(self, chunk: str) -> bytes:
        return b"".join(pack("<I", t) for w in self.split(chunk) for t in self.transducer.encode(w))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        chunks, memo = self.chunks(text), self.memo
        for at in range(0, len(chunks), MEMO_ENTRIES):
            self.prepare(chunks[at : at + MEMO_ENTRIES])
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:  # long chunks, or more distinct ones than the memo holds
            return b"".join([memo[c] if c in memo else self.long(c) for c in chunks])

    @staticmethod
    def chunks(text: str) -> list[str]:
        # One character at a time, so a sigma has one lower case wherever it stands.
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return _SPACE.split(text.strip()) if any(c in text for c in _EXTRA_SPACE) else text.split()

    def prepare(self, chunks: Iterable[str]) -> None:
        """Encode what the memo lacks, emptying it first where it would grow too large."""
        new = set(chunks).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = set(chunks)
        for part in batched(new, LEARN_CHUNKS):
            self.learn(part)

    def prime(self, texts: list[str | None]) -> None:
        """Encode the distinct chunks of some texts together, up to the memo's bound."""
        seen: set[str] = set()
        for text in texts:
            seen.update(c for c in self.chunks(text or "") if c not in self.memo)
            if len(seen) > MEMO_ENTRIES:
                break
        self.prepare(seen)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or "<" not in text:
            return self.plain(text)
        special = self.table.special
        return b"".join(np.array([special[p]], dtype="<u4").tobytes() if p in special else self.plain(p) for p in self.cut.split(text) if p)


class Decoder:
    """Ids to text, piece by piece.

    Files with a byte-level decoder go through a byte-to-text machine that holds back an unfinished
    UTF-8 sequence; files without a decoder give their tokens with single spaces between them.
    """

    def __init__(self, table: MergeTable):
        self.names, self.by_bytes = table.names, table.decoder == "ByteLevel"
        self.value = {c: b for b, c in enumerate(byte_alphabet())}
        self.reset()

    def reset(self) -> None:
        self.begun, self.machine = False, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        names = [self.names[i] for i in ids]
        if self.by_bytes:
            return self.machine.decode(bytes(self.value[c] for name in names for c in name))
        lead = " " if self.begun and names else ""
        self.begun = self.begun or bool(names)
        return lead + " ".join(names)

    def finish(self) -> str:
        rest = self.machine.decode(b"", True) if self.by_bytes else ""
        self.reset()
        return rest

    def decode(self, ids: bytes, step: int = 65_536) -> Iterator[str]:
        values = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(values), step):
            yield self.feed(values[at : at + step].tolist())
        yield self.finish()


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): ids as one binary of little-endian unsigned 32-bit integers."""
    table = MergeTable(path)

    def run(batches):
        encoder = Encoder(table)
        for b in batches:
            texts = b.column(1).to_pylist()
            encoder.prime(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(encoder.encode, texts), pa.binary())], ["key", "ids"])

    return map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, "key bigint, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) from the binary ids of ``encode``; null ids give empty text."""
    table = MergeTable(path)

    def run(batches):
        decoder = Decoder(table)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["".join(decoder.decode(i or b"")) for i in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return map_batches(encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")), run, "key bigint, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass over the rows.

    Only digests leave the task, so neither ids nor decoded texts cross back to the JVM.
    """
    table = MergeTable(path)

    def run(batches):
        encoder, decoder = Encoder(table), Decoder(table)
        for b in slices(batches, TEXTS):
            n, of_ids, of_text = [], [], []
            texts = b.column(1).to_pylist()
            encoder.prime(texts)
            give_back()
            for text in texts:
                ids = encoder.encode(text)
                said = hashlib.sha256()
                for piece in decoder.decode(ids):
                    said.update(piece.encode())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(said.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, schema).withColumnRenamed("key", key)
