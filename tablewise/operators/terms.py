"""Which terms occur in which documents, by automata that read each text once.

Terms are dealt into blocks of about ``BLOCK`` characters. A block becomes an Aho-Corasick automaton
(a trie whose missing steps are filled in by those of the longest other ending), which is small enough
to be sent to every task, and documents stream past in Arrow batches. A batch's texts are one row of
characters, cut into lanes that advance together, each with a run-up as long as the longest term; so a
long text takes no longer than many short ones. What moves afterwards are hits, one row a document and term.

Terms of more than a block would need a scan of all documents for each block. Of those, only the ones shorter
than ``GRAMS`` are looked for like that; a longer one is looked up by one of its own substrings of that many
characters, the one that the fewest terms have. Documents' substrings pass a bitmap of bounded size and meet
terms by a join, and the terms that a document meets are then looked for in its text. So the work grows with
the texts and terms, not with their product. Titles in terms are found in the same way, the other way round.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tablewise.sources.paths import discard, stored

#: Characters of terms of a block; cells of an automaton's table; characters scanned at once; length of a lane.
BLOCK, CELLS, CHARS, LANE = 100_000, 8_000_000, 1 << 20, 2048
#: Characters of an ending of a term by which titles look terms up.
_KEY = 64
#: Characters of the substrings by which longer terms are looked up; bits of the bitmap at most; terms of one
#: document beyond which they are looked for by an automaton.
GRAMS, BITS, SINGLE = (12, 6), 27, 30
#: No character, so no term goes across it.
_BREAK = 0x110000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, each followed by a break, and where each ends."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    out = np.full(int(ends[-1]) if len(ends) else 0, _BREAK, np.uint32)
    for p, e in zip(parts, ends.tolist()):
        out[e - 1 - len(p) : e - 1] = p
    return out, ends


class Automaton:
    """Finds all occurrences of its terms, which are different and not empty."""

    def __init__(self, terms: list[str]):
        self.terms, self.length = terms, np.array([len(t) for t in terms], np.int64)
        letters = sorted({ord(c) for t in terms for c in t})
        self.letter = np.zeros(_BREAK + 1, np.uint16 if len(letters) < 65_535 else np.uint32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        number = {chr(c): i for i, c in enumerate(letters, 1)}
        steps: list[dict[int, int]] = [{}]
        ends = np.zeros(len(terms), np.int64)
        for k, t in enumerate(terms):
            at = 0
            for c in t:
                step = steps[at]
                at = step.get(number[c], 0)
                if not at:
                    at = step[number[c]] = len(steps)
                    steps.append({})
            ends[k] = at
        self.next = np.zeros((len(steps), len(letters) + 1), np.int32)
        self.term = np.full(len(steps), -1, np.int32)
        self.term[ends] = np.arange(len(terms))
        # The state of the longest other ending, and the nearest of these at which a term ends.
        fall, self.other = np.zeros(len(steps), np.int32), np.zeros(len(steps), np.int32)
        level = [(0, c, s) for c, s in steps[0].items()]
        while level:
            parent, letter, state = np.array(level).T
            fall[state] = np.where(parent == 0, 0, self.next[fall[parent], letter])
            self.next[parent, letter] = state
            self.other[state] = np.where(self.term[fall[state]] >= 0, fall[state], self.other[fall[state]])
            self.next[state] = self.next[fall[state]]
            for s in state.tolist():
                if steps[s]:
                    self.next[s, list(steps[s])] = list(steps[s].values())
            level = [(s, c, n) for s in state.tolist() for c, n in steps[s].items()]
        self.ends_here = (self.term >= 0) | (self.other > 0)
        self.endings = sorted((t[i : i + _KEY], k) for k, t in enumerate(terms) for i in range(len(t)))

    @classmethod
    def within(cls, terms: list[str], cells: int) -> list[Automaton]:
        """As many automata as it takes for none, but for those of a single term, to have more cells."""
        size = (sum(map(len, terms)) + 1) * (len(set().union(*terms)) + 1)
        if size <= cells or len(terms) <= 1:
            return [cls(terms)] if terms else []
        half = len(terms) // 2
        return cls.within(terms[:half], cells) + cls.within(terms[half:], cells)

    def scan(self, codes: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, term) of all occurrences."""
        ahead = int(self.length.max()) - 1
        lane = max(lane, 4 * ahead)
        n = -(-len(codes) // lane)
        padded = np.zeros(n * lane + ahead, self.letter.dtype)
        padded[ahead : ahead + len(codes)] = self.letter[codes]
        lanes = np.lib.stride_tricks.as_strided(padded, (n, lane + ahead), (lane * padded.itemsize, padded.itemsize))
        state, places, states, begin = np.zeros(n, np.int32), [], [], np.arange(n) * lane - ahead
        for j in range(lane + ahead):
            state = self.next[state, lanes[:, j]]
            if j >= ahead:
                hit = np.flatnonzero(self.ends_here[state])
                if len(hit):
                    places.append(begin[hit] + j)
                    states.append(state[hit])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, state, out = np.concatenate(places), np.concatenate(states), []
        while len(state):
            own = self.term[state]
            out.append((place[own >= 0], own[own >= 0]))
            state = self.other[state]
            place, state = place[state > 0], state[state > 0]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))

    def holding(self, text: str) -> list[int]:
        """Terms that hold a text."""
        key = text[:_KEY]
        low = bisect_left(self.endings, key, key=lambda e: e[0])
        high = bisect_right(self.endings, key, low, key=lambda e: e[0][: len(key)])
        return [k for k in {e[1] for e in self.endings[low:high]} if len(text) <= _KEY or text in self.terms[k]]


def apart(owner: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, n): how many occurrences do not overlap, from the first on. ``owner`` names a text and a
    term, whose length each occurrence has."""
    order = np.lexsort((place, owner))
    owner, place, length = owner[order], place[order], length[order]
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
    n = np.diff(np.append(at, len(owner)))
    close = np.zeros(len(owner), bool)
    close[1:] = (owner[1:] == owner[:-1]) & (place[1:] - place[:-1] < length[1:])
    for g in np.unique(np.searchsorted(at, np.flatnonzero(close), "right") - 1).tolist():
        count, last, size = 0, -1, int(length[at[g]])
        for p in place[at[g] : at[g] + n[g]].tolist():
            if count == 0 or p - last >= size:
                count, last = count + 1, p
        n[g] = count
    return owner[at], n


def _scored(automaton: Automaton, titles: list[str], texts: list[str], everywhere: list[bool], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, confidence) of some documents."""
    m, docs = len(automaton.terms), len(titles)
    codes, ends = _codes([x for pair in zip(titles, texts) for x in pair])
    place, term = automaton.scan(codes)
    where = np.searchsorted(ends, place, "right")
    owner = (where // 2) * m + term
    in_title, in_text = where % 2 == 0, where % 2 == 1
    counted, n = apart(owner[in_text], place[in_text], automaton.length[term[in_text]])
    held = [k * m + t for k, title in enumerate(titles) if title for t in automaton.holding(title)]
    of_all = np.flatnonzero(np.repeat(np.array(everywhere, bool), m)) if any(everywhere) else np.zeros(0, np.int64)
    score = ((np.array(held, np.int64), 0.9), (owner[in_title], 0.9), (counted[n >= least], 0.7), (of_all, 0.5))
    every = np.concatenate([s[0] for s in score])
    best, first = np.unique(every, return_index=True)  # the first, and so the largest, of each
    confidence = np.repeat([s[1] for s in score], [len(s[0]) for s in score])[first]
    return best // m, best % m, confidence


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHARS bytes of text."""
    size = np.cumsum([len(t) + len(b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of n characters that no break is in, in order of place."""
    found = []
    for at in range(0, max(0, len(codes) - n + 1), CHARS):
        part = codes[at : at + CHARS + n - 1]
        size = len(part) - n + 1
        h, broken = np.zeros(size, np.uint64), np.concatenate([[0], np.cumsum(part == _BREAK)])
        for k in range(n):
            h = (h + part[k : k + size]) * _ODD
        h ^= h >> np.uint64(29)
        found.append((h * _ODD)[broken[n:] == broken[:-n]])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _keyed(known: DataFrame, n: int) -> DataFrame:
    """(term, gram): of each term the substring that the fewest terms have."""

    def run(batches):
        for whole in batches:
            for b in _batches(whole):
                own = b.column(0).to_pylist()
                found = [np.unique(grams(_codes([t])[0], n)) for t in own]
                names = b.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(h) for h in found])))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(found).view(np.int64))], ["term", "gram"])

    every = stored(known.select("term", F.lit("").alias("t"), F.col("term").alias("b")).mapInArrow(run, "term string, gram bigint"))
    shared = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    out = stored(every.join(shared, "gram").groupBy("term").agg(F.min(F.struct("n", "gram")).alias("m")).select("term", F.col("m.gram").alias("gram")))
    discard(every)
    return out


def _bitmap(keyed: DataFrame) -> tuple[int, np.ndarray]:
    """(shift, bits): which beginnings of hashes occur, whatever their number in at most 2^BITS bits."""
    bits = min(BITS, max(16, (16 * keyed.count()).bit_length()))
    low = max(0, bits - 6)

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << low, bool)
        own[table.column("place").to_numpy()] = True
        return pa.table([pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["slice", "bits"])

    place = F.shiftrightunsigned("gram", 64 - bits)
    split = keyed.select(F.shiftright(place, low).cast("int").alias("slice"), place.bitwiseAND(F.lit((1 << low) - 1)).alias("place")).distinct()
    out = np.zeros((64, (1 << low) // 8), np.uint8)
    for r in split.groupBy("slice").applyInArrow(pack, "slice int, bits binary").collect():
        out[r.slice] = np.frombuffer(r.bits, np.uint8)
    return 64 - bits, out.reshape(-1)


def _met(own: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """(at, term): terms whose substring is in a document's title or text; ``at`` names both."""
    sent = own.sparkSession.sparkContext.broadcast(_bitmap(keyed))

    def run(batches):
        shift, bits = sent.value
        for whole in batches:
            for batch in _batches(whole):
                at, titles, texts = (batch.column(i).to_pylist() for i in range(3))
                names, found = [], []
                for name, title, text in zip(at, titles, texts):
                    h = grams(_codes([title, text])[0], n)
                    place = h >> np.uint64(shift)
                    h = np.unique(h[(bits[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0])
                    if len(h):
                        names += [name] * len(h)
                        found.append(h)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(found).view(np.int64))], ["at", "gram"])

    return own.select("at", "t", "b").mapInArrow(run, "at string, gram bigint").join(keyed, "gram").select("at", "term")


def _looked_up(own: DataFrame, known: DataFrame, least: int, schema: StructType) -> DataFrame | None:
    """Matches of terms that have substrings of GRAMS characters; None if there are none."""
    met, upto = [], None
    for n in GRAMS:
        some = known.where((F.char_length("term") >= n) & (F.lit(True) if upto is None else F.char_length("term") < upto))
        keyed, upto = _keyed(some, n), n
        if keyed.limit(1).count():
            met.append(_met(own, keyed, n))
    if not met:
        return None
    listed = stored(reduce(DataFrame.unionByName, met).distinct().groupBy("at").agg(F.collect_list("term").alias("terms")))

    def run(batches):
        for whole in batches:
            for batch in _batches(whole):
                rows, hits = [], []
                for i, (title, text, terms) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                    score = {t: 0.9 if t in title else 0.7 if text.count(t) >= least else 0.0 for t in terms} if len(terms) <= SINGLE else _scores(title, text, sorted(terms), least)
                    own = [x for x in score.items() if x[1]]
                    rows += [i] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.float64())], ["key", "term", "confidence"])

    return own.join(listed, "at").select("key", "t", "b", "terms").mapInArrow(run, schema)


def _scores(title: str, text: str, terms: list[str], least: int) -> dict[str, float]:
    """What many terms of one document count."""
    out = {}
    for automaton in Automaton.within(terms, CELLS):
        codes, ends = _codes([title, text])
        place, term = automaton.scan(codes)
        inside = place >= ends[0]
        counted, n = apart(term[inside], place[inside], automaton.length[term[inside]])
        out |= {automaton.terms[k]: 0.7 for k in counted[n >= least].tolist()} | {automaton.terms[k]: 0.9 for k in term[~inside].tolist()}
    return out


def _occurring(own: DataFrame, known: DataFrame, least: int, schema: StructType) -> DataFrame:
    """(key, term, confidence) of documents (key, t, b, e, at) that hold terms, of any number of terms."""
    short = known.where(F.char_length("term") < min(GRAMS))
    parts = [_scanned(own, short, least, schema), _looked_up(own, known, least, schema)]
    found = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, found) if found else own.sparkSession.createDataFrame([], schema)


def _blocks(known: DataFrame) -> int:
    return -(-(known.agg(F.sum(F.char_length("term"))).first()[0] or 0) // BLOCK)


def _scanned(own: DataFrame, known: DataFrame, least: int, schema: StructType) -> DataFrame | None:
    """Matches by a scan of all documents for each block of terms; None if there are no terms."""
    spark, blocks = own.sparkSession, _blocks(known)
    dealt = stored(known.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(max(1, blocks))).cast("int")))

    def scanned(block: int) -> DataFrame:
        # A block is bounded in characters, so it may be held by the driver and every task.
        listed = sorted(r.term for r in dealt.where(F.col("block") == block).select("term").collect())
        sent = spark.sparkContext.broadcast(Automaton.within(listed, CELLS))

        def run(batches):
            for whole in batches:
                for batch in _batches(whole):
                    t, b, e = (batch.column(i).to_pylist() for i in (1, 2, 3))
                    for automaton in sent.value:
                        row, term, confidence = _scored(automaton, t, b, e, least)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([automaton.terms[k] for k in term.tolist()], pa.string()), pa.array(confidence, pa.float64())], ["key", "term", "confidence"])

        return own.select("key", "t", "b", "e").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [scanned(k) for k in range(blocks)]) if blocks else None


def match_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text", scope: str | None = None, least: int = 2) -> DataFrame:
    """(key, term, confidence): a term in the title, or a title in the term, counts 0.9, so often in the
    text 0.7, and a document of global scope 0.5 for every term; the largest counts.

    Lower case is compared. A term counts wherever its characters stand, within longer words too, and
    occurrences that overlap count once. Null and empty terms are left out, null titles and texts are
    empty; rows that share a key count as one document. Terms of up to a block are looked for in one scan;
    of more, those of up to five characters in a scan for each block, and longer ones by their substrings."""
    spark = docs.sparkSession
    everywhere = F.coalesce(F.col(scope) == "global", F.lit(False)) if scope else F.lit(False)
    own = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(text, F.lit(""))).alias("b"), everywhere.alias("e"))
    known = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    schema = StructType([own.schema["key"], StructField("term", StringType()), StructField("confidence", DoubleType())])
    blocks = _blocks(known)
    if not blocks:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    if blocks == 1:
        found = _scanned(own, known, least, schema)
    else:
        known = stored(known)
        named = own.withColumns({"e": F.lit(False), "at": F.md5(F.concat("t", F.lit("\0"), "b"))})
        titles = own.where("t <> ''").select(F.col("t").alias("term")).distinct()
        turned = known.select(F.col("term").alias("key"), F.lit("").alias("t"), F.col("term").alias("b"), F.lit(False).alias("e"), F.md5("term").alias("at"))
        held = _occurring(turned, stored(titles), 1, StructType([StructField("key", StringType()), *schema.fields[1:]])).select(F.col("key").alias("holder"), "term")
        inside = own.select("key", "t").join(held, F.col("t") == F.col("term")).select("key", F.col("holder").alias("term"), F.lit(0.9).alias("confidence"))
        found = _occurring(named, known, least, schema).unionByName(inside)
        if scope:
            found = found.unionByName(own.where("e").select("key").crossJoin(known).withColumn("confidence", F.lit(0.5)))
    return found.groupBy(F.col("key").alias(key), "term").agg(F.max("confidence").alias("confidence"))
